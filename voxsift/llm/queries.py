"""The numbered queries: each operator over its whole table, and the same result in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxsift.llm import conversation_repair, decontamination, html_extraction, language_id, line_dedup, near_duplicates, packing, personal_data, quality_classifier, quality_rules, signature_trees, token_alignment, url_filter


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def joined(names: Column) -> Column:
    return F.array_join(names, ",")


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    model = language_id.train(docs.where("not held_out"))
    return language_id.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "proportions")


def op2_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    found = html_extraction.extract(pages, html_extraction.train(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_bestfit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_units", "deleted", "text")


def op5_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_data.find(table(spark, sf, "documents").select("doc_id", "text"))
    counts = [personal_data.count_of(k, F.col("base")).alias(f"n_{k}") for k in personal_data.KINDS]
    base, every = personal_data.written(F.col("base")), personal_data.written(F.sort_array(F.concat("base", "added")))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, table(spark, sf, "labels"))
    return quality_rules.judge(docs, model).drop("text")


def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    evidence = quality_classifier.train(docs, table(spark, sf, "labels"))
    return quality_classifier.judge(docs, evidence, carry_text=False)


URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES)


def op9_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf, "documents"), words=2, percent=80)


_OP9 = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2
      THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM d),
  n AS (SELECT doc_id, coalesce(len(s), 0) AS n FROM s),
  k AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY ALL),
  e AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM k),
  p AS (SELECT x.rep AS a, y.rep AS b, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS c
    FROM e x JOIN e y ON x.g = y.g AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY ALL),
  l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (m + n - c)),
  u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r(a, b) AS (SELECT rep, rep FROM k UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
  c AS (SELECT a AS rep, min(b) AS c FROM r GROUP BY a),
  m AS (SELECT s.doc_id, c.c FROM s JOIN k ON list_sort(s.s) = k.s JOIN c USING (rep))
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.c, n.doc_id) AS component_id, coalesce(m.c, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN m USING (doc_id)"""


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(joined(F.col("items")), 256).alias("items_sha256"), "contaminated",
    )


_NORMAL = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_OP10 = rf"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_NORMAL} AS w FROM benchmark WHERE text IS NOT NULL),
  win AS (SELECT DISTINCT item, len(w) AS n, array_to_string(w, ' ') AS g FROM b WHERE len(w) BETWEEN 1 AND 12
    UNION SELECT DISTINCT item, 13, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' ')))
    FROM b WHERE len(w) >= 13),
  d AS (SELECT doc_id, coalesce({_NORMAL}, []) AS w FROM documents),
  size AS (SELECT DISTINCT n FROM win),
  pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size),
  occ AS (SELECT a.doc_id, a.i, a.n, win.item FROM pos a JOIN win ON win.n = a.n AND array_to_string(a.w[a.i : a.i + a.n - 1], ' ') = win.g),
  hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id),
  it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n > 0 AND 20 * hit.n >= len(d.w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return token_alignment.align(table(spark, sf, "documents"))


def op12_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return signature_trees.ngram_links(table(spark, sf, "documents"), words=5, percent=80)


_OP12 = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
  k AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY ALL),
  e AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM k),
  p AS (SELECT x.rep AS a, y.rep AS b, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS c
    FROM e x JOIN e y ON x.g = y.g AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY ALL),
  l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (m + n - c)),
  u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r(a, b) AS (SELECT rep, rep FROM k UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
  c AS (SELECT a AS rep, min(b) AS c FROM r GROUP BY a),
  m AS (SELECT s.doc_id, c.c FROM s JOIN k ON list_sort(s.s) = k.s JOIN c USING (rep))
SELECT s.doc_id, coalesce(len(s.s), 0) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id FROM s LEFT JOIN m USING (doc_id)"""


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    found = conversation_repair.repair(conversation_repair.damage(rows))
    name = conversation_repair.name_of("conv_id")
    seen = found.conversations.select(name.alias("name"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    every = rows.select(name.alias("name"), "conv_id").groupBy("name").agg(F.first("conv_id").alias("conv_id"))
    every = every.join(seen, "name", "left").join(conversation_repair.digests(found.turns), "name", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    repaired = F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), repaired)


# the checksum byte by byte, then costs from the last row back, then the letters from the first row on;
# states 1 to 4: nothing yet, system, user, assistant
_OP13 = r"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
      lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
  draws AS (SELECT keyed.* EXCLUDE (k), xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM keyed, t),
  harmed AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
      CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM draws WHERE f <> 0),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
      rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS l FROM harmed),
  marked AS (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
      CASE l WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 4 END AS r,
      i > 1 AND lag(l) OVER (PARTITION BY conv_id ORDER BY i) || l NOT IN ('su', 'ua', 'au') AS wrong FROM ordered),
  cut AS (SELECT *, NOT blank AND NOT dup AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
      CASE WHEN blank OR dup THEN 1000000 ELSE 0 END AS bar FROM marked),
  seen AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
      count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
      count(*) FILTER (wrong) AS illegal FROM cut GROUP BY conv_id),
  back AS (SELECT conv_id, n + 1 AS i, [0, 4, 2, 0] AS v FROM seen
    UNION ALL SELECT conv_id, i, [least(w[1], 2 + w[3], 4 + w[4]), least(w[2], 2 + w[3], 4 + w[4]), least(w[3], 2 + w[4]), least(w[4], 2 + w[3])]
    FROM (SELECT c.conv_id, c.i, [
        least(3 + v[1], bar + CAST(cut AS INT) + least(2 + v[3], CASE r WHEN 1 THEN v[2] WHEN 2 THEN v[3] ELSE 1000000 END)),
        least(3 + v[2], bar + CAST(cut AS INT) + least(2 + v[3], CASE r WHEN 2 THEN v[3] ELSE 1000000 END)),
        least(3 + v[3], bar + CAST(cut AS INT) + least(2 + v[4], CASE r WHEN 3 THEN v[4] ELSE 1000000 END)),
        least(3 + v[4], bar + CAST(cut AS INT) + least(2 + v[3], CASE r WHEN 2 THEN v[3] ELSE 1000000 END))] AS w
      FROM back JOIN cut c ON c.conv_id IS NOT DISTINCT FROM back.conv_id AND c.i = back.i - 1)),
  walk AS (SELECT conv_id, CAST(1 AS BIGINT) AS i, 1 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS turns FROM seen
    UNION ALL SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN r + 1 ELSE f END, audit || e,
      CASE e WHEN 'D' THEN turns WHEN 'K' THEN list_append(turns, role || ':' || text)
        ELSE list_append(turns, CASE f WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'R' THEN text ELSE '' END) END
    FROM (SELECT *, CASE WHEN last THEN 'I' WHEN 3 + after[s] = v[s] THEN 'D' WHEN 2 + v[f] = v[s] THEN 'I'
          WHEN bar = 0 AND (r = 1 AND s = 1 OR r = 2 AND s <> 3 OR r = 3 AND s = 3) AND CAST(cut AS INT) + after[r + 1] = v[s] THEN 'K' ELSE 'R' END AS e
      FROM (SELECT walk.*, b.v, x.v AS after, c.r, c.bar, c.cut, c.role, c.text, c.i IS NULL AS last, CASE walk.s WHEN 3 THEN 4 ELSE 3 END AS f
        FROM walk JOIN back b ON b.conv_id IS NOT DISTINCT FROM walk.conv_id AND b.i = walk.i
        LEFT JOIN cut c ON c.conv_id IS NOT DISTINCT FROM walk.conv_id AND c.i = walk.i
        LEFT JOIN back x ON x.conv_id IS NOT DISTINCT FROM walk.conv_id AND x.i = walk.i + 1)
      WHERE NOT (last AND s IN (1, 4)))),
  done AS (SELECT walk.conv_id, audit, sha256(array_to_string(turns, chr(10))) AS h FROM walk JOIN seen
    ON seen.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.i = n + 1 AND s IN (1, 4))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.v[1], 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN seen ON seen.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1 LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_html_extraction": op2_html_extraction,
    "op3_bestfit_packing": op3_bestfit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_url_filter": op8_url_filter,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_token_alignment": op11_token_alignment,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE = {"op9_minhash_near_dedup": _OP9, "op10_decontamination": _OP10, "op12_ngram_jaccard_join": _OP12, "op13_conversation_repair": _OP13}

"""The operators for training text on edge rows and against plain versions of themselves."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from voxsift.llm import decontamination, html_extraction, language_id, line_dedup, near_duplicates
from voxsift.llm import packing, personal_data, quality_classifier, quality_rules, url_filter

WORDS = [a + b for a in ("ba", "ko", "li", "mu", "ne") for b in ("ra", "so", "ti", "vu", "za", "pe", "ga")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, repeated rows, near copies, shared lines, and columns with clashing names."""
    line = prose(99, 60)
    texts = [prose(n, 120) for n in range(6)] + [None, "", "   \n\t ", "...!?", prose(7, 9000), prose(0, 120)]
    near = prose(1, 120).split(" ")
    near[5] = "changed"
    texts += [" ".join(near), prose(20, 30) + "\n" + line, line + "\n" + prose(21, 40), prose(22, 10) + "\n" + line + "\nend"]
    made = [(n, t, "xx", "s1" if n % 3 else None, 1, "a", "b") for n, t in enumerate(texts)]
    return [*made, made[0], (None, prose(2, 120), None, "s2", None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_near_duplicates_against_all_pairs(docs, rows):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(docs, words=2).collect()}
    sets = {}
    for number, text, *_ in rows:
        w = words_of((text or "").lower())
        if number is not None:
            sets[number] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    label = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    assert {g for g in got if g[0] is not None} == {(k, v, k == v) for k, v in label.items()}
    assert {g for g in got if g[0] is None} == {(None, 2, False), (None, None, True)}


def test_near_duplicates_of_a_star(spark):
    """A hub whose copies are no links of each other: the leader and block steps find what neighbours miss."""
    base = prose(50, 200).split(" ")
    texts = [" ".join(base)]
    for k in range(60):
        own = list(base)
        for p in random.Random(k).sample(range(200), 9):
            own[p] = f"w{k}x{p}"
        texts.append(" ".join(own))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_duplicates.near_duplicates(frame, words=2).collect()
    assert {r["component_id"] for r in found} == {0}


def test_near_duplicates_refuse_a_lower_threshold(docs):
    with pytest.raises(ValueError, match="below 80"):
        near_duplicates.near_duplicates(docs, percent=60)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert near_duplicates.near_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert packing.pack(none).count() == 0
    assert decontamination.find_contamination(none, items).count() == 0
    assert language_id.identify(none, language_id.train(none)).count() == 0
    assert quality_rules.judge(none, quality_rules.train(none, labels)).count() == 0
    assert quality_classifier.judge(none, quality_classifier.train(none, labels)).count() == 0
    assert personal_data.find(none).count() == 0
    assert url_filter.judge(pages, [("allow", "com", "/")]).count() == 0
    assert html_extraction.extract(pages, html_extraction.train(pages)).count() == 0


def test_line_dedup_keeps_first_copies(docs, rows):
    got = {(r["doc_id"], r["text"]): r for r in line_dedup.dedup_lines(docs).collect()}
    line = prose(99, 60)
    by_id = {r["doc_id"]: r for r in got.values() if r["doc_id"] is not None}
    assert by_id[13]["text"] == rows[13][1] and list(by_id[13]["deleted"]) == []
    assert by_id[14]["text"] == prose(21, 40) and list(by_id[14]["deleted"]) == [0]
    assert by_id[15]["text"] == prose(22, 10) + "\nend"
    assert by_id[11]["text"] == "" and by_id[0]["text"] == rows[0][1]
    assert by_id[6]["text"] is None and by_id[6]["n_units"] == 0
    assert sum(line in (r["text"] or "") for r in got.values()) == 1


def plain_line_dedup(texts, least):
    """Every run of lines with enough words that occurs before, by trying them all."""
    lines = {d: [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")] for d, t in texts.items()}
    first, gone = {}, {d: set() for d in texts}
    for d in sorted(lines):
        for s in range(len(lines[d])):
            count = 0
            for e in range(s, len(lines[d])):
                count += len(lines[d][e][1].split())
                if count >= least:
                    key = tuple(x for _, x in lines[d][s : e + 1])
                    if first.setdefault(key, (d, s)) != (d, s):
                        gone[d].update(k for k, _ in lines[d][s : e + 1])
    return {d: sorted(g) for d, g in gone.items()}


def test_line_dedup_against_all_runs(spark):
    draw = random.Random(5)
    pool = [prose(300 + k, draw.randint(1, 7)) for k in range(8)]
    texts = {d: "\n".join(draw.choice([*pool, ""]) for _ in range(draw.randint(1, 25))) for d in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: list(r["deleted"]) for r in line_dedup.dedup_lines(frame, min_words=12).collect()}
    assert got == plain_line_dedup(texts, 12)


def plain_sentence_dedup(texts, least):
    """As above, over sentences and lines, with places among all of them."""
    units = {d: [(k, x.strip()) for k, x in enumerate(re.split(r"(?<=\n)|(?<=[.!?] )", t)) if x.strip()] for d, t in texts.items()}
    first, gone = {}, {d: set() for d in texts}
    for d in sorted(units):
        for s in range(len(units[d])):
            count = 0
            for e in range(s, len(units[d])):
                count += len(units[d][e][1].split())
                if count >= least:
                    key = tuple(x for _, x in units[d][s : e + 1])
                    if first.setdefault(key, (d, s)) != (d, s):
                        gone[d].update(k for k, _ in units[d][s : e + 1])
    return {d: sorted(g) for d, g in gone.items()}


def test_line_dedup_finds_passages_inside_lines(spark):
    passage = ". ".join(prose(400 + k, 9) for k in range(5)) + ". "
    texts = {1: f"{prose(410, 8)}. {passage}{prose(411, 8)}.", 2: f"{prose(412, 8)}.\n{prose(413, 8)}. {passage}{prose(414, 8)}."}
    draw = random.Random(6)  # and texts of short and long sentences, some of them copied in part, against all runs
    pool = [prose(500 + k, draw.choice([1, 1, 2, 3, 5, 9, 14])) for k in range(60)]
    made = [[draw.choice(pool) + draw.choice([". ", "! ", "\n", ".\n", ". \n\n"]) for _ in range(draw.randint(1, 60))] for _ in range(20)]
    for k in range(20):
        source, at = draw.choice(made), draw.randint(0, 30)
        made.append(draw.choice(made)[:5] + source[at : at + draw.randint(3, 40)] + draw.choice(made)[:4])
    texts |= {d: "".join(t) for d, t in enumerate(made, 10)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame).collect()}
    assert got[2]["text"] == texts[2].replace(passage, "") and got[1]["text"] == texts[1]
    want = plain_sentence_dedup(texts, 40)
    assert {d: list(r["deleted"]) for d, r in got.items()} == want and sum(map(bool, want.values())) > 10


def test_line_dedup_cuts_alike_with_and_without_a_pattern(spark):
    texts = ["", "\n", "\n\na. \nb", "a.\tb!\x0b c? \rd", " e.  f.. g!? h\x0c\n", "é. \U0001f600! ü?\u00a0x.", "i. ", "?! \n\r\n j", "k\t\tl  m. . n"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for end, plain in [(line_dedup.LINE_END, r"(?<=\n)"), (line_dedup.SENTENCE_END, r"(?<=\n)|(?<=[.!?] )"), (r"(?<=;)", r"(?<=;)")]:
        want = [[re.sub(r"[\t-\r]", " ", x.strip(" \t\n\x0b\x0c\r")) for x in re.split(plain, t)] for t in texts]
        got = frame.select("text", line_dedup.bodies_of(F.col("text"), end).alias("b"), F.size(line_dedup.pieces_of(F.col("text"), end)).alias("n")).collect()
        assert {r["text"]: (list(r["b"]), r["n"]) for r in got} == {t: (w, len(w)) for t, w in zip(texts, want)}


def test_line_dedup_of_long_texts_of_short_units(spark):
    text = "".join(f"{k} w{k % 7}. " for k in range(3000))
    frame = spark.createDataFrame([(1, text), (2, "x y z. " + text)], "doc_id long, text string")
    assert {r["doc_id"]: len(r["deleted"]) for r in line_dedup.dedup_lines(frame).collect()} == {1: 0, 2: 3000}


def test_line_dedup_works_out_runs_once(spark):
    """Without a filter, put before the rows are made, in which all least runs are made too, and without a loop for each."""
    schema = "doc long, copy long, at array<int>, unit array<long>, words array<int>, marks array<int>"
    plan = line_dedup.least_runs(spark.createDataFrame([], schema), 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and not any("Filter" in line and "lambda" in line for line in plan.splitlines())


def test_packing_holds_every_token_once(docs, rows):
    got = packing.pack(docs, capacity=100, same_source=2).toPandas()
    assert got["n_tokens"].sum() == sum(len(words_of(r[1])) for r in rows)
    for _, own in got.groupby("bin_id"):
        own = own.sort_values("position")
        assert own["n_tokens"].sum() <= 100 and own["source"].value_counts().max() in (1, 2) or own["source"].isna().all()
        assert list(own["first_token"]) == [0, *own["n_tokens"].cumsum()[:-1]]
    texts = {r[0]: r[1] for r in rows}
    own = got.dropna(subset=["doc_id"])
    assert not own.assign(t=own["doc_id"].map(texts)).duplicated(["bin_id", "t"]).any()


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = packing.Bins(10, 1)
    assert bins.place(7, 0, 1)[0] == 0 and bins.place(6, 0, 2)[0] == 1
    assert bins.place(3, 0, 1) == (1, 6)  # bin 0 is tighter, but holds source 1
    assert bins.place(3, 0, 4) == (0, 7)


def plain_contamination(text, items, window):
    normal = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = normal(text), set(), set()
    for name, item in items:
        w = normal(item)
        size = min(window, len(w))
        runs = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if size else set()
        for k in range(len(words) - size + 1 if size else 0):
            if tuple(words[k : k + size]) in runs:
                hit.update(range(k, k + size))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_contamination_against_all_windows(spark):
    draw = random.Random(3)
    few = ["a", "B", "c", "é"]
    text = lambda n: " ".join(draw.choice(few) for _ in range(n))
    items = [(k, text(draw.randint(0, 9))) for k in range(12)] + [(12, None), (3, text(5))]
    texts = [text(draw.randint(0, 60)) for _ in range(80)] + [None, "", "--"]
    found = decontamination.find_contamination(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4
    )
    for r in found.collect():
        assert (r["n_words"], r["n_hit"], list(r["items"])) == plain_contamination(texts[r["doc_id"]], items, 4)


def test_contamination_in_several_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(k, prose(500 + k, 20)) for k in range(6)], "item_id long, text string")
    frame = spark.createDataFrame([(0, prose(501, 20) + " x " + prose(504, 20)), (1, prose(9, 50))], "doc_id long, text string")
    one = sorted(decontamination.find_contamination(frame, items).collect())
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 50)
    assert sorted(decontamination.find_contamination(frame, items).collect()) == one
    assert one[0]["n_hit"] == 40 and one[0]["contaminated"] and not one[1]["contaminated"]


def plain_measures(text):
    words = words_of(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_quality_measures_against_plain_counts(docs, rows):
    more = ["a b\na b\n\na b", "x " * 40, "é# 漢 |\x0b&", prose(1, 30) + " " + prose(1, 30)]
    spark = docs.sparkSession
    frame = spark.createDataFrame([(n, t) for n, t in enumerate([*[r[1] for r in rows[:10]], *more])], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    got = quality_rules.judge(frame, quality_rules.train(frame, labels)).collect()
    texts = {r["doc_id"]: r["text"] for r in got}
    for r in got:
        n, chars, symbols, lines, repeated = plain_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n) and not (r["base_failed"] and r["kept"])


def test_language_mixture(spark):
    one, two = "the cat and the dog were there ", "der hund und die katze waren dort "
    frame = spark.createDataFrame([(k, (one if k % 2 else two) * 5, "en" if k % 2 else "de") for k in range(40)], "doc_id long, text string, lang string")
    model = language_id.train(frame)
    asked = [(0, one), (1, two), (2, None), (3, "123 !?"), (4, one * 30 + two * 90)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[k]["lang_pred"] for k in range(5)] == ["en", "de", "und", "und", "de"]
    assert set(got[4]["proportions"]) == {"en", "de"} and 0.6 < got[4]["score"] < 0.9 and got[2]["score"] == 0.0


def test_personal_data_against_plain_patterns(spark):
    from voxsift.llm.personal_data import KINDS

    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(digits):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0

    def good(kind, body):
        digits = re.sub("[^0-9]", "", body)
        if kind == "ip":
            return all(int(x) <= 255 for x in body.split("."))
        return kind == "email" or (10 <= len(digits) <= 15 if kind == "phone" else 14 <= len(digits) <= 19 and luhn(digits))

    draw = random.Random(1)
    bits = ["a.b@c.de", "_x@y", ".z9", "@", "1.2.3.4", ".300", "256.1.1.1", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+1 (212) 555-0100", "+", "é", "\x01", "(", "007.0.0.1", "12", "a@b.c_d@e.ff"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 12))) for _ in range(400)] + [None, "", "1.1.1.1 " * 600]
    rows = personal_data.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        want = sorted((m.start(), n, m.end(), m[0]) for n, k in enumerate(KINDS) for m in re.finditer(plain[k], text) if good(k, m[0]))
        assert [tuple(s) for s in r["base"]] == want, text


def test_personal_data_learns_a_context(spark):
    rows = [(k, f"please mail me at user{k}@mail.example.com today") for k in range(20)] + [(50, "please mail me at anna(at)example0com now"), (51, "room 12")]
    got = {r["doc_id"]: [s["body"] for s in r["added"]] for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == ["anna(at)example0com"] and got[51] == [] and got[0] == []


def test_url_rules_and_spread(spark):
    link = '<a href="https://{}/">x</a>'
    rows = [
        (0, "http://a.com/x", link.format("friend.org")), (1, "http://friend.org/q?a", None), (2, "http://bad.net/es/1", ""),
        (3, "http://fan.org/", link.format("bad.net")), (4, "HTTP://WWW.Example.com/en/1#t", ""), (5, "http://x.example.com/en/", ""),
        (6, None, None), (7, "nothing", ""), (8, "http://acom/", ""), (9, "http://b.com?x", ""),
    ]
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert [got[k]["verdict"] for k in range(10)] == ["allow", "allow", "block", "block", "allow", "block", "allow", "allow", "allow", "allow"]
    assert [got[k]["rule"] for k in (0, 1, 2, 4, 5, 9)] == ["com/", None, "net/es/", "www.example.com/en/", "example.com/en/", None]
    assert got[1]["trust"] > 0 and got[3]["distrust"] > 0
    assert (got[6]["host"], got[6]["path"], got[4]["host"], got[1]["path"]) == ("", "", "www.example.com", "/q")


def test_html_blocks_and_held_out_layouts():
    found = html_extraction.blocks_of("<p>a&amp;b<br>c  <b>d<p>e<script>x='</p>'</script></div><!-- <p>no</p> --><li>f<li>g")
    assert [b.text for b in found] == ["a&b c d", "e", "f", "g"] and html_extraction.blocks_of(None) == []
    numbers = html_extraction.Numbers()
    pages = [(html_extraction.features(b, numbers), y) for b, y in html_extraction.layouts(WORDS, 120)]
    field = html_extraction.fit(pages[:90], steps=40)
    right = [p == t for f, y in pages[90:] for p, t in zip(field.decode(f), y)]
    assert sum(right) / len(right) > 0.95


def test_quality_classifier_separates(spark):
    rows, labels = [], []
    for k in range(240):
        bad, toxic = k % 4 == 0, k % 6 == 1
        text = "!! ".join(prose(k, 40).upper().split()) if bad else prose(k, 40) + (" awfulword nastyword" if toxic else "")
        rows.append((k, text, "xx", f"s{k % 3}" if k % 7 else None))
        labels.append((k, int(not bad), int(toxic)))
    frame = spark.createDataFrame([*rows, (900, None, None, None), (901, "", None, None)], "doc_id long, text string, lang string, source string")
    evidence = quality_classifier.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.judge(frame, evidence).collect()}
    right = [got[k] == bool(q and not t) for k, q, t in labels]
    assert sum(right) / len(right) > 0.97 and len(got) == 242


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
    assert 0 < docs.count() < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).count()

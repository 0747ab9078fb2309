"""Domain columns, prompts, the two extraction passes, views, batches and the stream."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from voxsift.checks.common import (
    EVERY_WORD, MATCHED, REFUSED, SELECTION, WORDS, Query, domains, failing_model, lexicon, reviews, wordy_model,
    sql_list, sql_matched, sql_text, table,
)
from voxsift.domains import (
    AI_RATING_TEXT, CATCH_ALL_FIELDS, KEYWORDS_TEXT, RATIONALE_TEXT, SENTIMENT_TEXT, DomainSet,
)
from voxsift.functions import documents as doc
from voxsift.functions.domain_columns import (
    category_key, condition_map, config_rows, flat_rows, split_categories, valid_categories,
)
from voxsift.operators.joins import join_small
from voxsift.plans.batches import AnalysisTarget, run_batches, run_threaded, without_failures
from voxsift.plans.extraction import (
    ANALYST, CATCH_ALL_WHEN, FEEDBACK_MARK, IDENTIFY_TASK, ModelExtraction, field_list, identify_prompt, lexicon_model,
)
from voxsift.plans.model import ModelSettings, embedding_call
from voxsift.plans.views import (
    ViewSource, build_analysis_views, catch_all_view, domain_summary, domain_view, error_view, read_view,
)
from voxsift.sources.config_table import load_domains, save_domains
from voxsift.staging import fresh_path
from voxsift.streaming.reviews import read_review_files, stream_analysis


# --- configuration taken from the data: one domain per source ----------------------------------------


def _source_domains(spark, sf) -> DataFrame:
    """A domain row for every source of the documents; its extras name the languages found there."""
    extras = F.transform(
        F.array_sort(F.collect_set("lang")),
        lambda lang: F.struct(
            F.concat(F.lit("about_"), lang).alias("item_name"),
            F.concat(F.lit("is {topic} in "), lang).alias("item_description"),
        ),
    )
    replaced = F.struct(F.lit("sentiment").alias("item_name"), F.lit("mood of {topic}").alias("item_description"))
    return (
        table(spark, sf, "documents")
        .groupBy(F.initcap("source").alias("topic"))
        .agg(F.array_append(extras, replaced).alias("extras"))
        .select(
            "topic",
            F.lit("when {topic} isn't other").alias("when"),
            F.lit("what {topic} says").alias("details"),
            F.lit(SENTIMENT_TEXT).alias("sentiment"),
            F.lit(KEYWORDS_TEXT).alias("keywords"),
            F.replace(F.lit(AI_RATING_TEXT), F.lit("{topic}"), F.col("topic")).alias("ai_rating"),
            F.replace(F.lit(RATIONALE_TEXT), F.lit("{topic}"), F.col("topic")).alias("rationale"),
            "extras",
        )
    )


_TOPICS = "(SELECT DISTINCT upper(source[1]) || lower(source[2:]) AS topic, source FROM documents)"


def f1_category_key(spark, sf) -> DataFrame:
    return _source_domains(spark, sf).select("topic", category_key(F.col("topic")).alias("key"))


def f2_condition_map(spark, sf) -> DataFrame:
    return condition_map(_source_domains(spark, sf)).select(F.explode("conditions").alias("key", "condition"))


def f5_flat_fields(spark, sf) -> DataFrame:
    return flat_rows(_source_domains(spark, sf)).select("topic", F.explode("fields").alias("field", "description"))


def f6_serialised_domain(spark, sf) -> DataFrame:
    raw = config_rows(_source_domains(spark, sf))
    path = "$.serialized."
    return raw.select(
        "topic",
        F.get_json_object("raw", "$.topic").alias("outer_topic"),
        F.get_json_object("raw", path + "when").alias("condition"),
        F.get_json_object("raw", path + "extras[0].item_name").alias("first_extra"),
    )


def _stored(spark, sf) -> str:
    path = fresh_path(spark, "domains")
    save_domains(spark, DomainSet.from_frame(_source_domains(spark, sf)), path)
    return path


def s7_save_domains(spark, sf) -> DataFrame:
    return spark.read.parquet(_stored(spark, sf)).select(
        "topic", F.get_json_object("raw", "$.serialized.rationale").alias("rationale")
    )


def s8_load_domains(spark, sf) -> DataFrame:
    loaded = load_domains(spark, _stored(spark, sf))
    return loaded.to_frame(spark).select("topic", "when", "ai_rating", F.size("extras").alias("extras"))


# --- documents and category lists -------------------------------------------------------------------


def f8_split_categories(spark, sf) -> DataFrame:
    parts = split_categories(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(parts).cast("long").alias("parts"), F.md5(F.array_join(parts, "|")).alias("joined")
    )


def _listed(spark, sf) -> DataFrame:
    names = F.array(F.concat("source", F.lit("details")), F.concat("lang", F.lit("details")), F.lit("Src3details"),
                    F.concat("source", F.lit("details")))
    return table(spark, sf, "documents").select("doc_id", names.alias("named"))


_VALID = ["src1details", "src3details", "dedetails"]


def f9_valid_categories(spark, sf) -> DataFrame:
    kept = valid_categories(F.col("named"), _VALID)
    return _listed(spark, sf).select("doc_id", F.array_join(kept, ",").alias("categories"))


def j3_category_lookup(spark, sf) -> DataFrame:
    config = flat_rows(_source_domains(spark, sf)).select(
        category_key(F.col("topic")).alias("key"), F.size("fields").cast("long").alias("fields")
    )
    named = _listed(spark, sf).select("doc_id", F.explode(F.array_distinct("named")).alias("key"))
    return join_small(named, config, ["key"], F.col("doc_id"))


def _analysed(spark, sf) -> DataFrame:
    return lexicon().analyse(reviews(spark, sf))


def f10_encoded_result(spark, sf) -> DataFrame:
    return _analysed(spark, sf).select(
        "review_id",
        F.array_join(F.json_object_keys("analysis"), ",").alias("keys"),
        F.array_join(F.json_object_keys(doc.json_path("analysis", "category_breakdown")), ",").alias("filled"),
        doc.json_path("analysis", "category_selection_rationale").alias("rationale"),
        F.array_join(doc.json_strings(doc.json_path("analysis", "all_categories")), ",").alias("all_categories"),
    )


def f11_json_path(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", doc.json_path("props", "k").alias("k"), doc.json_path("props", "none").alias("absent")
    )


def _keyword_texts(spark, sf) -> DataFrame:
    as_list = F.to_json(F.array("lang", "source"))
    return table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "en", as_list).otherwise(F.concat_ws(", ", "lang", "source")).alias("words")
    )


def f12_json_strings(spark, sf) -> DataFrame:
    return _keyword_texts(spark, sf).select(
        "doc_id", F.array_join(doc.json_strings(F.col("words")), "|").alias("words")
    )


def f13_keywords(spark, sf) -> DataFrame:
    """Keywords by field name: lists in a domain, JSON text in the catch-all."""
    analysed = _analysed(spark, sf)
    product = read_view(analysed, domain_view, domains().topics[0]).select("review_id", "keywords")
    rest = read_view(analysed, catch_all_view).select("review_id", "keywords")
    return product.unionByName(rest).select("review_id", F.array_join("keywords", "|").alias("keywords"))


def f14_rating_text(spark, sf) -> DataFrame:
    return reviews(spark, sf).select("review_id", F.col("rating").cast("string").alias("rating"))


# --- extraction -------------------------------------------------------------------------------------


def _model(**options) -> ModelExtraction:
    return ModelExtraction(domains(), lexicon_model(WORDS), ModelSettings("lexicon"), **options)


def l1_identify_prompt(spark, sf) -> DataFrame:
    d = domains()
    prompt = identify_prompt(F.col("review"), d.keys(), d.conditions())
    return reviews(spark, sf).select("review_id", F.md5(prompt).alias("prompt_md5"))


def _selection(analysed: DataFrame) -> DataFrame:
    return analysed.select(
        "review_id",
        F.array_join(doc.json_strings(doc.json_path("analysis", "category_selection")), ",").alias("selection"),
        doc.json_path("analysis", "category_selection_rationale").alias("rationale"),
    )


def l2_identify(spark, sf) -> DataFrame:
    return _selection(_model().analyse(reviews(spark, sf)))


def l3_field_list(spark, sf) -> DataFrame:
    chosen = lexicon().analyse(reviews(spark, sf))
    selection = doc.json_strings(doc.json_path("analysis", "category_selection"))
    categories = valid_categories(selection, domains().keys())
    return chosen.select("review_id", field_list(categories, domains()).alias("fields"))


def _filled(analysed: DataFrame) -> DataFrame:
    """The fields of all categories of a row, side by side."""

    def of(key: str, field: str):
        return doc.json_path("analysis", "category_breakdown", key, field)

    return analysed.select(
        "review_id",
        of("productdetails", "details").alias("product_details"),
        of("productdetails", "sentiment").alias("product_sentiment"),
        of("deliverydetails", "keywords").alias("delivery_keywords"),
        of("deliverydetails", "ai_rating").alias("delivery_rating"),
        of("catchalldetails", "rationale").alias("rest_rationale"),
        doc.error_of().alias("error"),
    )


def l4_fill(spark, sf) -> DataFrame:
    return _filled(_model().analyse(reviews(spark, sf)))


def l4_fill_lexicon(spark, sf) -> DataFrame:
    return _filled(_analysed(spark, sf))


def l5_errors_as_data(spark, sf) -> DataFrame:
    return _filled(ModelExtraction(domains(), failing_model).analyse(reviews(spark, sf)))


def l6_distributed(spark, sf) -> DataFrame:
    return _filled(_model(tasks=8).analyse(reviews(spark, sf)))


def l7_bounded_concurrency(spark, sf) -> DataFrame:
    return _filled(_model(threads=8, tasks=4).analyse(reviews(spark, sf)))


def l7_once_per_text(spark, sf) -> DataFrame:
    return _filled(_model(threads=4, once_per_text=True).analyse(reviews(spark, sf)))


def _letter_counts(settings):
    return lambda texts: [[float(len(t)), float(t.count("e")), float(t.count("."))] for t in texts]


def l10_embeddings(spark, sf) -> DataFrame:
    embedded = reviews(spark, sf).withColumn("vector", embedding_call(F.col("review"), _letter_counts, ModelSettings()))
    return embedded.select("review_id", *[F.get("vector", F.lit(i)).cast("long").alias(n) for i, n in enumerate("xyz")])


# --- views ------------------------------------------------------------------------------------------


def _view_rows(view: DataFrame) -> DataFrame:
    return view.withColumn("keywords", F.array_join("keywords", "|"))


def v1_domain_view(spark, sf) -> DataFrame:
    return _view_rows(read_view(_analysed(spark, sf), domain_view, domains().topics[0]))


def v1_domain_view_capital(spark, sf) -> DataFrame:
    return _view_rows(read_view(_analysed(spark, sf), domain_view, domains().topics[1]))


def v2_catch_all_view(spark, sf) -> DataFrame:
    return _view_rows(read_view(_analysed(spark, sf), catch_all_view))


def l5_wrong_shape(spark, sf) -> DataFrame:
    """A model that replies with text in place of an object for reviews with a certain word."""
    analysed = ModelExtraction(domains(), wordy_model).analyse(reviews(spark, sf))
    return analysed.select("review_id", doc.error_of().alias("error"))


def v3_error_view(spark, sf) -> DataFrame:
    return read_view(ModelExtraction(domains(), failing_model).analyse(reviews(spark, sf)), error_view)


def v4_all_views(spark, sf) -> DataFrame:
    ModelExtraction(domains(), failing_model).analyse(reviews(spark, sf)).createOrReplaceTempView("voxsift_analysed")
    names = build_analysis_views(
        spark, ViewSource("voxsift_analysed"), domains(), temporary=True, prefix="voxsift"
    )
    counts = [spark.table(n).agg(F.lit(n).alias("view"), F.count(F.lit(1)).alias("rows")) for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def domain_sentiment(spark, sf) -> DataFrame:
    return domain_summary(_analysed(spark, sf), domains())


# --- batches and stream -----------------------------------------------------------------------------


def _seeded(spark, sf) -> AnalysisTarget:
    target = AnalysisTarget(spark, fresh_path(spark, "target"))
    target.seed(reviews(spark, sf))
    return target


def b1_resumable_batches(spark, sf) -> DataFrame:
    """A run stopped after one batch, then a second run for the rest."""
    target = _seeded(spark, sf)
    run_batches(target, lexicon(), batch_size=400, max_batches=1, fold=False)
    run_batches(target, lexicon(), batch_size=10_000)
    return _filled(target.read())


def b2_threaded_batches(spark, sf) -> DataFrame:
    target = _seeded(spark, sf)
    run_threaded(target, _model(threads=8), batch_size=10_000)
    return _filled(target.read())


def b3_reprocess_failures(spark, sf) -> DataFrame:
    failed = ModelExtraction(domains(), failing_model).analyse(reviews(spark, sf))
    return without_failures(failed).select("review_id", F.col("analysis").isNull().alias("pending"))


def b3_reprocessed_run(spark, sf) -> DataFrame:
    """Failures set back and analysed again by a model that can read them."""
    target = _seeded(spark, sf)
    run_batches(target, ModelExtraction(domains(), failing_model), batch_size=100_000)
    target.reprocess_failures()
    run_batches(target, _model(), batch_size=100_000)
    return _filled(target.read())


def s12_retried_commit(spark, sf) -> DataFrame:
    """A micro-batch committed twice: each entry of the log counts what that commit wrote, the target holds it once."""
    target = _seeded(spark, sf)
    analysed = lexicon().analyse(target.rows()).select(*target.rows().columns)
    target.record(analysed, "stream", 0, "stream")
    target.record(analysed.where("review_id % 2 = 0"), "stream", 0, "stream")
    logged = target.history().where("operation = 'stream'").select(F.lit("logged").alias("what"), F.col("rows_in").alias("rows"))
    return logged.unionByName(target.read().agg(F.count("analysis").alias("rows")).select(F.lit("held").alias("what"), "rows"))


def b4_stream(spark, sf) -> DataFrame:
    """The documents arriving as files, into a target that already holds those with a label; a third of them arrive a second
    time in a later micro-batch."""
    target = AnalysisTarget(spark, fresh_path(spark, "target"))
    rows = reviews(spark, sf)
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"))
    target.seed(rows.join(labelled, "review_id"))
    folder, progress = fresh_path(spark, "arriving"), fresh_path(spark, "stream-progress")
    for part in (rows.where("review_id % 3 < 2"), rows.where("review_id % 3 > 0")):
        part.write.mode("append").parquet(folder)
        stream_analysis(read_review_files(spark, folder, rows.schema), target, lexicon(), progress).awaitTermination()
    return _filled(target.read())


QUERIES: dict[str, Query] = {
    "domain_sentiment": domain_sentiment,
    "l5_wrong_shape": l5_wrong_shape,
    "s12_retried_commit": s12_retried_commit,
    "f1_category_key": f1_category_key,
    "f2_condition_map": f2_condition_map,
    "f5_flat_fields": f5_flat_fields,
    "f6_serialised_domain": f6_serialised_domain,
    "s7_save_domains": s7_save_domains,
    "s8_load_domains": s8_load_domains,
    "f8_split_categories": f8_split_categories,
    "f9_valid_categories": f9_valid_categories,
    "j3_category_lookup": j3_category_lookup,
    "f10_encoded_result": f10_encoded_result,
    "f11_json_path": f11_json_path,
    "f12_json_strings": f12_json_strings,
    "f13_keywords": f13_keywords,
    "f14_rating_text": f14_rating_text,
    "l1_identify_prompt": l1_identify_prompt,
    "l2_identify": l2_identify,
    "l3_field_list": l3_field_list,
    "l4_fill": l4_fill,
    "l4_fill_lexicon": l4_fill_lexicon,
    "l5_errors_as_data": l5_errors_as_data,
    "l6_distributed": l6_distributed,
    "l7_bounded_concurrency": l7_bounded_concurrency,
    "l7_once_per_text": l7_once_per_text,
    "l10_embeddings": l10_embeddings,
    "v1_domain_view": v1_domain_view,
    "v1_domain_view_capital": v1_domain_view_capital,
    "v2_catch_all_view": v2_catch_all_view,
    "v3_error_view": v3_error_view,
    "v4_all_views": v4_all_views,
    "b1_resumable_batches": b1_resumable_batches,
    "b2_threaded_batches": b2_threaded_batches,
    "b3_reprocess_failures": b3_reprocess_failures,
    "b3_reprocessed_run": b3_reprocessed_run,
    "b4_stream": b4_stream,
}


# --- the same in SQL --------------------------------------------------------------------------------


def _filled_sql(failing: bool = False) -> str:
    ok = "NOT refused" if failing else "true"
    error = f"CASE WHEN refused THEN {sql_text(f'cannot read {chr(39)}{REFUSED}{chr(39)}')} END" if failing else "CAST(NULL AS VARCHAR)"
    return f"""WITH {MATCHED} SELECT review_id,
        CASE WHEN {ok} AND len(p) > 0 THEN 'mentions ' || array_to_string(p, ', ') END AS product_details,
        CASE WHEN {ok} AND len(p) > 0 THEN mood END AS product_sentiment,
        CASE WHEN {ok} AND len(d) > 0 THEN '["' || array_to_string(d, '","') || '"]' END AS delivery_keywords,
        CASE WHEN {ok} AND len(d) > 0 THEN CAST(rating AS VARCHAR) END AS delivery_rating,
        CASE WHEN {ok} AND len(p) = 0 AND len(d) = 0 THEN 'matched no listed word' END AS rest_rationale,
        {error} AS error FROM m"""


def _view_sql(words: str, extra: str) -> str:
    return f"""WITH {MATCHED} SELECT review_id, 'mentions ' || array_to_string({words}, ', ') AS details,
        mood AS sentiment, array_to_string({words}, '|') AS keywords, CAST(rating AS VARCHAR) AS ai_rating,
        {sql_matched(words)} AS rationale{extra} FROM m WHERE len({words}) > 0"""


def _prompt_head() -> str:
    d = domains()
    lines = [
        ANALYST, IDENTIFY_TASK, f"categories: {', '.join(d.keys())}",
        f"when to use each: {json.dumps(d.conditions(), ensure_ascii=False)}",
        "use catchalldetails if none of them applies",
        'reply: {"categories": [names], "rationale": the reasons, step by step}',
    ]
    return "\n".join(lines) + FEEDBACK_MARK


def _field_texts() -> dict[str, str]:
    texts = {d.key: {"when": d.condition, "fields": d.extracted_fields()} for d in domains()}
    texts["catchalldetails"] = {"when": CATCH_ALL_WHEN, "fields": CATCH_ALL_FIELDS}
    return {k: f'"{k}": ' + json.dumps(v, ensure_ascii=False) for k, v in texts.items()}


def _field_list_sql() -> str:
    t = _field_texts()
    p, d, c = (sql_text(t[k]) for k in ("productdetails", "deliverydetails", "catchalldetails"))
    return f"""WITH {MATCHED} SELECT review_id, '{{' || CASE WHEN len(p) > 0 AND len(d) > 0 THEN {p} || ', ' || {d}
        WHEN len(p) > 0 THEN {p} WHEN len(d) > 0 THEN {d} ELSE {c} END || '}}' AS fields FROM m"""


_FILLED = _filled_sql()
_SELECTION_SQL = f"WITH {MATCHED} SELECT review_id, {SELECTION} AS selection, {sql_matched(EVERY_WORD)} AS rationale FROM m"
_LISTED = "(SELECT doc_id, [source || 'details', lang || 'details', 'Src3details', source || 'details'] AS named FROM documents)"

ORACLE: dict[str, str] = {
    "domain_sentiment": f"""WITH {MATCHED}, u AS (
        SELECT 'productdetails' AS domain, mood, rating FROM m WHERE len(p) > 0
        UNION ALL SELECT 'deliverydetails', mood, rating FROM m WHERE len(d) > 0
        UNION ALL SELECT 'catchalldetails', mood, rating FROM m WHERE len(p) = 0 AND len(d) = 0)
        SELECT domain, mood AS sentiment, count(*) AS reviews, round(avg(rating), 6) AS mean_ai_rating
        FROM u GROUP BY domain, mood""",
    "f1_category_key": f"SELECT topic, source || 'details' AS key FROM {_TOPICS}",
    "f2_condition_map": f"""SELECT source || 'details' AS key, 'when ' || source || 'details isn''t other' AS condition
        FROM {_TOPICS}""",
    "f5_flat_fields": f"""SELECT topic, 'topic' AS field, topic AS description FROM {_TOPICS}
        UNION ALL SELECT topic, 'when', 'when {{topic}} isn''t other' FROM {_TOPICS}
        UNION ALL SELECT topic, 'details', 'what {{topic}} says' FROM {_TOPICS}
        UNION ALL SELECT topic, 'sentiment', 'mood of ' || topic FROM {_TOPICS}
        UNION ALL SELECT topic, 'keywords', {sql_text(KEYWORDS_TEXT)} FROM {_TOPICS}
        UNION ALL SELECT topic, 'ai_rating', replace({sql_text(AI_RATING_TEXT)}, '{{topic}}', topic) FROM {_TOPICS}
        UNION ALL SELECT topic, 'rationale', replace({sql_text(RATIONALE_TEXT)}, '{{topic}}', topic) FROM {_TOPICS}
        UNION ALL SELECT topic, 'about_' || lang, 'is ' || topic || ' in ' || lang
          FROM (SELECT DISTINCT source, lang FROM documents) JOIN {_TOPICS} t USING (source)""",
    "f6_serialised_domain": f"""SELECT topic, topic AS outer_topic, 'when {{topic}} isn''t other' AS condition,
        'about_' || min(lang) AS first_extra FROM documents JOIN {_TOPICS} t USING (source) GROUP BY topic""",
    "s7_save_domains": f"SELECT topic, replace({sql_text(RATIONALE_TEXT)}, '{{topic}}', topic) AS rationale FROM {_TOPICS}",
    "s8_load_domains": f"""SELECT topic, 'when {{topic}} isn''t other' AS "when",
        replace({sql_text(AI_RATING_TEXT)}, '{{topic}}', topic) AS ai_rating,
        CAST(count(DISTINCT lang) + 1 AS INTEGER) AS extras
        FROM documents JOIN {_TOPICS} t USING (source) GROUP BY topic""",
    "f8_split_categories": """WITH s AS (SELECT conv_id, turn,
          list_transform(string_split(text, ','), lambda x: trim(x, ' ')) AS parts FROM conversations)
        SELECT conv_id, turn, len(parts) AS parts, md5(array_to_string(parts, '|')) AS joined FROM s""",
    "f9_valid_categories": f"""WITH k AS (SELECT doc_id, list_filter(named[1:3],
          lambda c: list_contains({sql_list([*_VALID, 'catchalldetails'])}, c)) AS kept FROM {_LISTED})
        SELECT doc_id, CASE WHEN len(kept) = 0 THEN 'catchalldetails' ELSE array_to_string(kept, ',') END AS categories
        FROM k""",
    "j3_category_lookup": f"""SELECT d.doc_id, c.source || 'details' AS key, c.fields FROM documents d
        JOIN (SELECT source, count(DISTINCT lang) + 7 AS fields FROM documents GROUP BY source) c
          ON d.source = c.source""",
    "f10_encoded_result": f"""WITH {MATCHED} SELECT review_id,
        'category_breakdown,category_selection,category_selection_rationale,all_categories' AS keys,
        CASE WHEN len(p) = 0 AND len(d) = 0 THEN 'catchalldetails' ELSE {SELECTION} END AS filled,
        {sql_matched(EVERY_WORD)} AS rationale, 'productdetails,deliverydetails' AS all_categories FROM m""",
    "f11_json_path": """SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS absent
        FROM events""",
    "f12_json_strings": """SELECT doc_id, CASE WHEN lang = 'en' THEN lang || '|' || source END AS words FROM documents""",
    "f13_keywords": f"""WITH {MATCHED} SELECT review_id, array_to_string(p, '|') AS keywords FROM m
        WHERE len(p) > 0 OR len(d) = 0""",
    "f14_rating_text": "SELECT doc_id AS review_id, CAST(doc_id % 5 + 1 AS VARCHAR) AS rating FROM documents",
    "l1_identify_prompt": f"SELECT doc_id AS review_id, md5({sql_text(_prompt_head())} || text) AS prompt_md5 FROM documents",
    "l2_identify": _SELECTION_SQL,
    "l3_field_list": _field_list_sql(),
    "l4_fill": _FILLED,
    "l4_fill_lexicon": _FILLED,
    "l5_errors_as_data": _filled_sql(failing=True),
    "l6_distributed": _FILLED,
    "l7_bounded_concurrency": _FILLED,
    "l7_once_per_text": _FILLED,
    "l10_embeddings": """SELECT doc_id AS review_id, length(text) AS x, length(text) - length(replace(text, 'e', '')) AS y,
        length(text) - length(replace(text, '.', '')) AS z FROM documents""",
    "v1_domain_view": _view_sql("p", ", CAST(NULL AS VARCHAR) AS arrived_whole"),
    "v1_domain_view_capital": _view_sql("d", ""),
    "v2_catch_all_view": f"""WITH {MATCHED} SELECT review_id, 'mentions no listed word' AS details, mood AS sentiment,
        '' AS keywords, CAST(rating AS VARCHAR) AS ai_rating, 'matched no listed word' AS rationale
        FROM m WHERE len(p) = 0 AND len(d) = 0""",
    "l5_wrong_shape": f"""WITH {MATCHED} SELECT review_id, CASE WHEN refused THEN 'reply has a wrong shape in ' ||
        CASE WHEN len(p) = 0 AND len(d) = 0 THEN 'catchalldetails' ELSE replace({SELECTION}, ',', ', ') END END AS error FROM m""",
    "s12_retried_commit": """SELECT 'logged' AS what, count(*) AS rows FROM documents
        UNION ALL SELECT 'logged', count(*) FROM documents WHERE doc_id % 2 = 0
        UNION ALL SELECT 'held', count(*) FROM documents""",
    "v3_error_view": f"""WITH {MATCHED} SELECT review_id, {sql_text(f"cannot read '{REFUSED}'")} AS error_details
        FROM m WHERE refused""",
    "v4_all_views": f"""WITH {MATCHED}
        SELECT 'voxsift_product' AS view, count(*) AS rows FROM m WHERE NOT refused AND len(p) > 0
        UNION ALL SELECT 'voxsift_Delivery', count(*) FROM m WHERE NOT refused AND len(d) > 0
        UNION ALL SELECT 'voxsift_catchall', count(*) FROM m WHERE NOT refused AND len(p) = 0 AND len(d) = 0
        UNION ALL SELECT 'voxsift_errors', count(*) FROM m WHERE refused""",
    "b1_resumable_batches": _FILLED,
    "b2_threaded_batches": _FILLED,
    "b3_reprocess_failures": f"WITH {MATCHED} SELECT review_id, refused AS pending FROM m",
    "b3_reprocessed_run": _FILLED,
    "b4_stream": _FILLED,
}

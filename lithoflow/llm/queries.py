"""The queries of the text problems (2, 4, 7, 8, 9, 10) over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.functions.text import nonblank
from lithoflow.llm import canonical, encoding, lookalike, mixing, offensive, packing, tokens
from lithoflow.operators import packed
from lithoflow.session import cut, table


def long_fields(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """One row per record and field: (record_id, field_name, value)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    return df.select(F.col(key).alias("record_id"), F.inline(pairs)).where("record_id is not null")


def geology_fields(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    return long_fields(table(spark, d, "geology_features"), "feature_id", *fields)


def known_words(spark: SparkSession, d: str) -> list[str]:
    """Labels of the reference list: 844 entries, fixed in size."""
    return [x for r in table(spark, d, "reference_terms").select("label_ja", "label_kana", "label_en").collect() for x in r if x]


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore(geology_fields(spark, d, "raw_unit_name_ja", "raw_lithology", "raw_age"), known_words(spark, d)).withColumnRenamed("record_id", "feature_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_restored(spark, d).select("feature_id", "field_name").distinct()


def p7_fields(spark: SparkSession, d: str) -> DataFrame:
    terms = long_fields(table(spark, d, "l1_geology_terms"), "term_id", "match_keywords_ja").withColumn("table_name", F.lit("l1_geology_terms"))
    return geology_fields(spark, d, "raw_unit_name_ja", "raw_lithology").withColumn("table_name", F.lit("geology_features")).unionByName(terms)


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent(p7_fields(spark, d), known_words(spark, d)).select("table_name", "record_id", "field_name", "value", "form")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_forms(spark, d).select("table_name", "record_id", "field_name").distinct()


def p7_stable(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, field_name, n_values, n_unstable): the distinct values, and how many of them have a form
    that the same rewriter would change again."""
    fields = p7_fields(spark, d).where(nonblank("value")).select("table_name", "field_name", "value").distinct()
    values = lookalike.clean_values(fields, known_words(spark, d))
    rewriter = lookalike.fit(values)
    forms = cut(lookalike.forms(values, rewriter))
    again = lookalike.forms(forms.select(F.col("form").alias("value")).distinct(), rewriter).select(F.col("value").alias("form"), F.lit(1).alias("unstable"))
    marked = fields.join(forms.join(again, "form").select("value", "unstable"), "value", "left")
    return marked.groupBy("table_name", "field_name").agg(F.count_distinct("value").alias("n_values"), F.count("unstable").alias("n_unstable"))


def p4_matched(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, field_name, pos, item, ref_id) of all values that are not a label as they stand."""
    names = geology_fields(spark, d, "raw_unit_name_ja", "raw_lithology")
    keywords = long_fields(table(spark, d, "l1_geology_terms"), "term_id", "match_keywords_ja")
    fields = names.unionByName(keywords).where(nonblank("value"))
    entries = table(spark, d, "reference_terms")
    labels = entries.select(F.col("label_ja").alias("item")).where("item is not null").distinct()
    plain = r"^ +| +$"
    trimmed = F.regexp_replace("value", plain, "")
    # most values are labels as they stand and go nowhere
    fields = fields.distinct().withColumn("item", trimmed).join(labels, "item", "left_anti").drop("item").withColumn("split", F.col("field_name") != "raw_unit_name_ja")
    values = lookalike.clean_values(names.unionByName(keywords), known_words(spark, d)).select("value")
    # a value is cut the way its field asks for, and both ways only if both kinds of fields hold it
    items = F.when(F.col("split"), packed.split_values(F.col("value"), F.lit(False), plain)).otherwise(F.array(trimmed))
    per_value = fields.select("value", "split").distinct().join(values, "value").select("value", "split", F.posexplode(items).alias("p", "item"))
    per_value = cut(per_value.join(labels, "item", "left_anti"))
    found = canonical.match(per_value.select("item").distinct(), entries)
    per_value = per_value.join(found, "item").select("value", "split", (F.col("p") + 1).cast("int").alias("pos"), "item", "ref_id")
    return fields.join(per_value, ["value", "split"]).select("record_id", "field_name", "pos", "item", "ref_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matched(spark, d).select("record_id", "field_name", "pos", "ref_id").distinct()


def counted(spark: SparkSession, d: str) -> DataFrame:
    return cut(tokens.counted(table(spark, d, "documents")))


def capacities(spark: SparkSession, d: str) -> list[int]:
    return [r[0] for r in table(spark, d, "pack_capacities").select("capacity_tokens").collect()]


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(counted(spark, d), capacities(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d))


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, placed, whole, within): whether a document is in containers, all its tokens are there and it is cut
    only if it must be, and none of its containers holds more than its capacity."""
    docs, most = counted(spark, d), max(capacities(spark, d), default=0)
    packed_ = cut(packing.pack(docs, capacities(spark, d)))
    over = packed_.where("container_id is not null").groupBy("container_id").agg((F.sum("n_tokens") <= F.max("capacity_tokens")).alias("fits"))
    per = packed_.join(over, "container_id", "left").groupBy("doc_id").agg(F.count("container_id").alias("n"), F.sum("n_tokens").alias("got"), F.min(F.coalesce("fits", F.lit(True))).alias("within"))
    whole = (F.col("got") == F.col("n_tokens")) & (F.col("n") <= F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / most)))
    return docs.join(per, "doc_id", "left").select("doc_id", (F.col("n") > 0).alias("placed"), whole.alias("whole"), "within")


def p9_targets(spark: SparkSession, d: str) -> DataFrame:
    """(source, target_share, scaled_share, max_repeats, within_repeats, near_target): what the mix holds of what
    it was to hold; near is within 0.05 of all tokens."""
    s = p9_shares(spark, d)
    return s.select("source", "target_share", F.round("scaled_share", 9).alias("scaled_share"), "max_repeats", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("reached_share") - F.col("scaled_share")) < 0.05).alias("near_target"))


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    docs = counted(spark, d)
    return mixing.mix(docs, mixing.plan_table(spark, mixing.plan(docs, table(spark, d, "mix_targets"))))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = counted(spark, d)
    planned = mixing.plan_table(spark, mixing.plan(docs, table(spark, d, "mix_targets")))
    return mixing.shares(mixing.mix(docs, planned), planned)


def p10_model(spark: SparkSession, d: str) -> offensive.Model:
    return offensive.fit(table(spark, d, "documents"), table(spark, d, "doc_review_labels"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return offensive.scores(table(spark, d, "documents"), p10_model(spark, d))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return offensive.sentences(table(spark, d, "documents"), p10_model(spark, d)).distinct()


def p10_scored(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, in_range, has_sentence, agrees): every document has a score of 0 to 1, a likeliest sentence where it
    has text, and offending sentences only with a score above 0."""
    s = p10_scores(spark, d)
    return s.select("doc_id", F.col("score").between(0, 1).alias("in_range"), F.col("worst").isNotNull().alias("has_sentence"), ((F.col("n_offending") == 0) | (F.col("score") > 0)).alias("agrees")).distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("n_offending > 0").select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return offensive.rates(table(spark, d, "documents"), cut(p10_scores(spark, d)))

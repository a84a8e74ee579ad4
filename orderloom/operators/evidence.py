"""Evidence for (line, item) candidates of all lanes, and their heuristic rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.text import normalise_order_text, normalise_text, normalise_unit, numeric_tokens, overlap, token_set
from orderloom.operators import lanes, retrieval, tfidf
from orderloom.operators.fuzzy import weighted_ratio_column
from orderloom.session import cut

#: The features a ranker sees, in this order.
FEATURES = [
    "fuzzy", "word", "char", "item_code_exact", "barcode_exact", "part_number_exact", "alias_exact", "alias_confidence", "brand_match", "family_overlap",
    "size_overlap", "size_completeness", "unit_match", "active_twin", "identifier_conflict", "attribute_conflict",
]

#: Shares of the heuristic score, what an attribute conflict costs, and the most confidence without an identifier.
WEIGHTS = {"fuzzy": 0.35, "word": 0.25, "char": 0.25, "brand_match": 0.08, "family_overlap": 0.07, "size_overlap": 0.08, "unit_match": 0.03}
CONFLICT_COST, MOST = 0.25, 0.995


def hybrid_candidates(lines: DataFrame, items: DataFrame, aliases: DataFrame, k: int = 20) -> DataFrame:
    """(line_id, tenant, q, item_code, word, char, fuzzy, a flag per exact lane, alias, identifier_conflict) of every lane's candidates.

    A word or character score that its lane didn't rank among its k best is 0;
    fuzzy is the ratio whichever lane the candidate is of. The lexical lanes are
    asked once per distinct query text and give a line one list; what its
    identifiers name joins that list, so a candidate becomes a row only once.
    """
    items = cut(items, "items")
    live = items.where("enabled AND NOT misc")
    docs = live.select("tenant", "item_code", F.col("search_text").alias("text"))
    asked = cut(lines.select("line_id", "tenant", normalise_order_text(F.concat_ws(" ", "raw_text", "notes")).alias("q")), "asked")
    lexical = retrieval.search(asked, docs, {"word": tfidf.word_grams, "char": tfidf.char_grams}, k, fuzzy=True)
    exact = lanes.identifier_lanes(lines, items).groupBy("line_id", "item_code").agg(*(F.max(F.col("lane") == n).alias(f"{n}_exact") for n in ("item_code", "barcode", "part_number")))
    alias = lanes.alias_lane(lines, aliases, items).where("live").select("line_id", "item_code", F.lit(True).alias("alias_exact"), F.col("confidence").alias("alias_confidence"))
    no, zero = F.lit(False), F.lit(0.0)
    flags = ["item_code_exact", "barcode_exact", "part_number_exact", "alias_exact"]
    named = exact.join(alias, ["line_id", "item_code"], "full").groupBy("line_id").agg(
        F.map_from_entries(F.collect_list(F.struct("item_code", F.struct(*(F.coalesce(c, no).alias(c) for c in flags), F.coalesce("alias_confidence", zero).alias("alias_confidence"))))).alias("named")
    )
    row = lambda code, word, char, ratio: F.struct(code.alias("item_code"), word.alias("word"), char.alias("char"), ratio.alias("fuzzy"))
    listed = asked.join(lexical, ["tenant", "q"], "left").join(named, "line_id", "left")
    of_lanes = F.transform(F.coalesce("found", F.expr("filter(found, x -> false)"), F.array().cast(lexical.schema["found"].dataType)), lambda c: row(c["item_code"], c["word"], c["char"], c["ratio"]))
    others = F.array_except(F.coalesce(F.map_keys("named"), F.array().cast("array<string>")), F.transform("of_lanes", lambda c: c["item_code"]))
    listed = cut(listed.withColumn("of_lanes", of_lanes).select("line_id", "tenant", "q", "named", "of_lanes", others.alias("others")), "listed")
    # a ratio is computed here only where no lexical lane gives it; ratios are costly per row, so rows are spread whatever their size in bytes
    n_parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = listed.select("line_id", "tenant", "q", "named", F.explode("others").alias("item_code")).join(live.select("tenant", "item_code", "search_text"), ["tenant", "item_code"]).repartition(n_parts, "line_id", "item_code")
    more = more.select("line_id", "tenant", "q", "named", "item_code", zero.alias("word"), zero.alias("char"), F.round(weighted_ratio_column(F.col("q"), F.col("search_text")), 8).alias("fuzzy"))
    every = listed.select("line_id", "tenant", "q", "named", F.inline("of_lanes")).unionByName(more)
    flag = F.try_element_at("named", F.col("item_code"))
    return every.select(
        "line_id", "tenant", "q", "item_code", "word", "char", "fuzzy", *(F.coalesce(flag[c], no).alias(c) for c in flags), F.coalesce(flag["alias_confidence"], zero).alias("alias_confidence"),
        # identifiers name live entries of the line's tenant only
        (F.coalesce(F.size("named"), F.lit(0)) > 1).alias("identifier_conflict"),
    )


def evidence(candidates: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """Adds the features of each candidate and its heuristic score and confidence."""
    line = lines.select(
        "line_id", normalise_text(F.col("raw_text")).alias("lt"), normalise_unit(F.col("uom_text")).alias("unit")
    ).select("line_id", "lt", "unit", token_set(F.col("lt")).alias("l_tokens"), numeric_tokens(F.col("lt")).alias("l_numbers"))
    conv = F.from_json("uom_conversions", "array<struct<uom:string,conversion_factor:double>>")
    units = F.array_distinct(F.concat(F.array(normalise_unit(F.col("stock_uom"))), F.coalesce(F.transform(conv, lambda c: normalise_unit(c["uom"])), F.array().cast("array<string>"))))
    w = Window.partitionBy("tenant", "base")
    item = (
        items.where("enabled AND NOT misc").withColumn("twins", F.count(F.lit(1)).over(w))
        .select(
            "tenant", "item_code", normalise_text(F.col("brand")).alias("brand_text"), units.alias("units"), (F.col("twins") > 1).alias("active_twin"),
            token_set(normalise_text(F.element_at(F.split("item_group", ">"), -1))).alias("family"),
            numeric_tokens(normalise_text(F.concat_ws(" ", "item_name", "description"))).alias("i_numbers"),
        )
    )
    both = candidates.join(line, "line_id").join(item, ["tenant", "item_code"])
    rows = both.select(
        *candidates.columns, "active_twin",
        ((F.col("brand_text") != "") & F.contains("lt", "brand_text")).alias("brand_match"), overlap(F.col("l_tokens"), F.col("family")).alias("family_overlap"),
        overlap(F.col("l_numbers"), F.col("i_numbers")).alias("size_overlap"), overlap(F.col("i_numbers"), F.col("l_numbers")).alias("size_completeness"),
        ((F.col("unit") != "") & F.array_contains("units", F.col("unit"))).alias("unit_match"), ((F.col("unit") != "") & ~F.array_contains("units", F.col("unit"))).alias("_unit_conflict"),
        ((F.size("l_numbers") > 0) & (F.size("i_numbers") > 0)).alias("_both_numbers"),
    )
    rows = rows.withColumn("attribute_conflict", (F.col("_both_numbers") & (F.col("size_overlap") < 1)) | F.col("_unit_conflict")).drop("_both_numbers", "_unit_conflict")
    n = lambda c: F.col(c).cast("double")
    identifier = F.greatest(n("item_code_exact"), n("barcode_exact"), n("part_number_exact"), F.when(F.col("alias_exact"), F.col("alias_confidence")).otherwise(0.0))
    weighted = sum((n(f) * w for f, w in WEIGHTS.items()), F.lit(0.0))
    rows = rows.withColumn("score", F.greatest(identifier, F.least(F.lit(1.0), weighted)))
    return rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(MOST), F.col("score") - CONFLICT_COST * n("attribute_conflict"))))


def ranked(rows: DataFrame, k: int = 20) -> DataFrame:
    """Adds place by confidence, score and code, and the first place's lead; keeps k per line."""
    w = Window.partitionBy("line_id").orderBy(F.desc("confidence"), F.desc("score"), F.asc("item_code"))
    placed = rows.withColumn("place", F.row_number().over(w)).withColumn("_next", F.lead("confidence").over(w))
    lead = F.when(F.col("place") == 1, F.col("confidence") - F.coalesce("_next", F.lit(0.0))).otherwise(0.0)
    return placed.withColumn("margin", lead).drop("_next").where(F.col("place") <= k)


def prediction_rows(placed: DataFrame) -> DataFrame:
    """(line_id, confidence, margin, candidates): the first three as 'code:score|...' with six decimals."""
    item = F.struct("place", F.concat("item_code", F.lit(":"), F.format_string("%.6f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))).alias("t"))
    top = placed.where("place <= 3").groupBy("line_id").agg(F.array_sort(F.collect_list(item)).alias("c"), F.max("margin").alias("margin"), F.max("confidence").alias("confidence"))
    return top.select("line_id", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), F.array_join(F.transform("c", lambda x: x["t"]), "|").alias("candidates"))

"""Quantities recorded in different units, brought to one unit per item.

Distinct unit spellings are mapped to canonical units by a character n-gram
inverted index over known spellings; the candidates it returns are verified by a
weighted edit distance. The alias dictionary so made is joined to all rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known spellings of each unit, letters only, in lower case.
UNIT_SPELLINGS = {
    "piece": ["piece", "pieces", "pcs", "pc", "pce", "pces", "each", "ea", "unit", "units", "nos", "no", "biji", "keping"],
    "dozen": ["dozen", "dozens", "doz", "dz"],
    "gross": ["gross", "grs"],
    "pair": ["pair", "pairs", "pr", "prs"],
    "kilogram": ["kilogram", "kilograms", "kg", "kgs", "kilo", "kilos"],
    "gram": ["gram", "grams", "g", "gr", "gm", "gms", "gramme", "grammes"],
    "pound": ["pound", "pounds", "lb", "lbs"],
    "tonne": ["tonne", "tonnes", "ton", "tons", "t", "mt"],
    "litre": ["litre", "litres", "liter", "liters", "l", "ltr", "ltrs"],
    "millilitre": ["millilitre", "millilitres", "milliliter", "milliliters", "ml", "mls"],
    "metre": ["metre", "metres", "meter", "meters", "m", "mtr", "mtrs"],
    "centimetre": ["centimetre", "centimetres", "centimeter", "centimeters", "cm", "cms"],
    "packet": ["packet", "packets", "pack", "packs", "pkt", "pkts", "pk"],
    "carton": ["carton", "cartons", "ctn", "ctns", "cart", "crtn"],
    "box": ["box", "boxes", "bx", "bxs"],
    "bag": ["bag", "bags", "bg"],
    "bundle": ["bundle", "bundles", "bdl", "bdls", "bndl"],
    "drum": ["drum", "drums", "drm"],
    "roll": ["roll", "rolls", "rl", "rls"],
    "length": ["length", "lengths", "lgth", "lgths", "lgt", "lgts", "len"],
}
#: Measures of one kind: unit -> (base unit, how many of it).
MEASURES = {
    "dozen": ("piece", 12.0), "gross": ("piece", 144.0), "pair": ("piece", 2.0),
    "gram": ("kilogram", 0.001), "pound": ("kilogram", 0.45359237), "tonne": ("kilogram", 1000.0),
    "millilitre": ("litre", 0.001), "centimetre": ("metre", 0.01),
}
#: Numbers written as words.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
_VULGAR = {"½": 0.5, "¼": 0.25, "¾": 0.75}

_DEC = r"\d[\d,]*(?:\.\d+)?|\.\d+"
_NUM = rf"(?:{_DEC})\s*[x*×]\s*(?:{_DEC})|\d+\s+\d+/\d+|\d+/\d+|\d*\s*[½¼¾]|{_DEC}|(?:{'|'.join(NUMBER_WORDS)})\b"
_UNIT = r"[a-z]+\.?"
_PACK = r"(?:\s*(?:/|@|of\s|\(|x)\s*\d+\s*(?:[a-z]+\.?)?\s*\)?)"


def weighted_distance(a: str, b: str) -> float:
    """Edit distance in which slips that unit labels show cost less.

    Dropping a vowel, a doubled letter or a final s costs little; two letters
    swapped cost less than two changes; all else costs one.
    """

    def drop(w: str, i: int) -> float:
        if i == len(w) - 1 and w[i] == "s":
            return 0.3
        if i and w[i] == w[i - 1]:
            return 0.3
        return 0.5 if w[i] in "aeiou" else 1.0

    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        rows[i][0] = rows[i - 1][0] + drop(a, i - 1)
    for j in range(1, len(b) + 1):
        rows[0][j] = rows[0][j - 1] + drop(b, j - 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = rows[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else 1)
            best = min(same, rows[i - 1][j] + drop(a, i - 1), rows[i][j - 1] + drop(b, j - 1))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2][j - 2] + 0.6)
            rows[i][j] = best
    return rows[-1][-1]


def spelling(col: Column) -> Column:
    """A unit label as letters in lower case; null if it has none."""
    letters = F.regexp_replace(F.lower(col), r"[^\p{L}]", "")
    return F.when(letters != "", letters)


def _grams(col: Column) -> Column:
    padded = F.concat(F.lit("^"), col, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2)))


def unit_aliases(spellings: DataFrame, accept: float = 0.2, margin: float = 0.1, overlap: float = 0.4) -> DataFrame:
    """(spelling, unit): the canonical unit of each distinct spelling that has one.

    spellings: a column ``spelling`` as ``spelling()`` makes it. Candidates share
    bigrams with a known spelling (Dice ``overlap`` or more); one is taken if its
    weighted distance is at most ``accept`` of the longer word and no other unit
    comes within ``margin`` of it. Words of one or two letters must be equal to a
    known spelling. Null, empty and far-off spellings give no row.
    """
    spark = spellings.sparkSession
    known = [(s, u) for u, words in UNIT_SPELLINGS.items() for s in words]
    index = spark.createDataFrame(known, "known string, unit string").select("*", _grams(F.col("known")).alias("g"))
    index = index.select("known", "unit", F.size("g").alias("kn"), F.explode("g").alias("gram"))
    words = spellings.select("spelling").where("spelling IS NOT NULL AND spelling <> '' AND length(spelling) <= 40").distinct()
    grams = words.select("spelling", _grams(F.col("spelling")).alias("g"))
    grams = grams.select("spelling", F.size("g").alias("sn"), F.explode("g").alias("gram"))
    # the index has a fixed size: the known spellings above
    pairs = grams.join(F.broadcast(index), "gram").groupBy("spelling", "known", "unit", "sn", "kn").count()
    pairs = pairs.where((F.col("spelling") == F.col("known")) | ((2 * F.col("count") / (F.col("sn") + F.col("kn")) >= overlap) & (F.length("spelling") > 2) & (F.length("known") > 2)))

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(x, y) / max(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    scored = pairs.select("spelling", "unit", distance("spelling", "known").alias("d")).groupBy("spelling", "unit").agg(F.min("d").alias("d"))
    ranked = scored.groupBy("spelling").agg(F.array_sort(F.collect_list(F.struct("d", "unit"))).alias("r"))
    first, second = F.col("r")[0], F.try_element_at("r", F.lit(2))
    clear = second.isNull() | (first["d"] == 0) | (second["d"] - first["d"] >= margin)
    return ranked.where((first["d"] <= accept) & clear).select("spelling", first["unit"].alias("unit"))


def number_of(col: Column) -> Column:
    """A written number: decimals, thousands, fractions, products, words; else null."""
    t = F.trim(F.lower(col))

    def dec(c: Column) -> Column:
        thousands = c.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$")
        return F.when(thousands, F.regexp_replace(c, ",", "")).otherwise(F.regexp_replace(c, ",", ".")).try_cast("double")

    g = lambda p, k: F.regexp_extract(t, p, k)
    product = rf"^({_DEC})\s*[x*×]\s*({_DEC})$"
    mixed = r"^(?:(\d+)\s+)?(\d+)/(\d+)$"
    vulgar = r"^(\d*)\s*([½¼¾])$"
    part = F.lit(None).cast("double")
    for sign, v in _VULGAR.items():
        part = F.when(g(vulgar, 2) == sign, v).otherwise(part)
    word = F.lit(None).cast("double")
    for w, v in NUMBER_WORDS.items():
        word = F.when(t == w, float(v)).otherwise(word)
    whole = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    below = g(mixed, 3).try_cast("double")
    return (
        F.when(t.rlike(product), dec(g(product, 1)) * dec(g(product, 2)))
        .when(t.rlike(mixed), F.when(below > 0, whole(g(mixed, 1)) + g(mixed, 2).try_cast("double") / below))
        .when(t.rlike(vulgar), whole(g(vulgar, 1)) + part)
        .when(t.rlike(rf"^(?:{_DEC})$"), dec(t))
        .otherwise(word)
    )


def _pack(col: str) -> Column:
    n = F.regexp_extract(col, r"(\d+)", 1).try_cast("double")
    word = spelling(F.regexp_extract(col, r"\d+\s*([a-z]+)", 1))
    return F.when((n > 0) & (word.isNull() | word.isin(UNIT_SPELLINGS["piece"])), n)


#: A whole cell: number, unit and pack size, like '2 ctn' or '3 x 4 bags/15'.
_CELL = rf"^({_NUM})\s*({_UNIT})?({_PACK})?$"
_LABEL = rf"^({_UNIT})({_PACK})?$"
#: Where a quantity may stand in free text, the most explicit first.
_IN_TEXT = [
    rf"\bqty\s*[:.=]?\s*({_NUM})\s*({_UNIT})?({_PACK})?\s*$",
    rf"\(\s*({_NUM})\s*({_UNIT})({_PACK})?\s*\)\s*$",
    rf"\s-\s*({_NUM})\s*({_UNIT})({_PACK})?\s*$",
    rf"^\s*({_NUM})\s*({_UNIT})({_PACK})?\s+(?:of\s+)?(?=\S)",
]


def measures_in(name: Column) -> Column:
    """Number-unit runs of a name ('40 pcs', '2.5kg') as text without blanks."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+(?:[.,]\d+)?\s*[a-z]+)"), 1)
    return F.transform(runs, lambda r: F.regexp_replace(r, r"\s+", ""))


def quantities(lines: DataFrame) -> DataFrame:
    """line_id and the places where its quantity may stand, as number, spelling, pack, unread and run.

    qty and uom_text first; raw_text only if both are missing. unread: a unit is
    written that can't even be split off. run: number and unit as they stand in
    free text.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    base = lines.select("line_id", "tenant", blank("qty").alias("q"), blank("uom_text").alias("u"), blank("raw_text").alias("text"))
    cell, label = F.coalesce("q", "u"), F.col("u")
    part = lambda c, p, k: F.regexp_extract(c, p, k)
    unit = part(cell, _CELL, 2)
    own = F.col("q").isNull() | (unit != "")
    written = F.array(F.struct(
        part(cell, _CELL, 1).alias("number"),
        F.when(own, unit).otherwise(part(label, _LABEL, 1)).alias("unit"),
        F.when(own, part(cell, _CELL, 3)).otherwise(part(label, _LABEL, 2)).alias("pack"),
        F.coalesce(F.col("q").isNotNull() & (unit == "") & ~label.rlike(_LABEL), F.lit(False)).alias("unread"),
    ))
    free = F.array(*(
        F.struct(part("text", p, 1).alias("number"), part("text", p, 2).alias("unit"), part("text", p, 3).alias("pack"), F.lit(False).alias("unread"))
        for p in _IN_TEXT
    ))
    in_cells = F.col("q").isNotNull() | label.isNotNull()
    found = F.when(in_cells, written).otherwise(free)
    places = base.select("line_id", "tenant", "text", in_cells.alias("in_cells"), F.posexplode(found).alias("place", "f")).where("f.number <> ''")
    run = F.when(F.col("in_cells"), "").otherwise(F.regexp_replace(F.concat("f.number", "f.unit"), r"\s+", ""))
    return places.select(
        "line_id", "tenant", "text", "place", number_of(F.col("f.number")).alias("number"),
        spelling(F.col("f.unit")).alias("spelling"), _pack("f.pack").alias("pack"), "f.unread", run.alias("run"),
    )


def item_units(catalogue: DataFrame) -> DataFrame:
    """(tenant, item_code, item_name, stock, spelling, factor) for each unit an item is told in; a null spelling row per item."""
    items = catalogue.select("tenant", "item_code", "item_name", "stock_uom", "uom_conversions").where("item_code IS NOT NULL").distinct()
    parsed = F.from_json("uom_conversions", "array<struct<uom:string,conversion_factor:double>>")
    return items.select(
        "tenant", "item_code", "item_name", spelling(F.col("stock_uom")).alias("stock"),
        F.explode_outer(F.when(F.size(parsed) > 0, parsed)).alias("c"),
    ).select("tenant", "item_code", "item_name", "stock", spelling(F.col("c.uom")).alias("spelling"), F.col("c.conversion_factor").alias("factor"))


def quantities_in_stock_unit(lines: DataFrame, labels: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(line_id, qty_milli): thousandths of the item's stock unit, half up.

    A missing unit is the stock unit. A number that can't be read, a unit that
    is unknown or that the item can't be told in, a line without label or whose
    item is not in the catalogue gives no row. Rows that are repeated count
    once; a line with two labelled items is told in the first by code.
    """
    label = labels.where("line_id IS NOT NULL AND item_code IS NOT NULL").groupBy("line_id").agg(F.min("item_code").alias("item_code"))
    wanted = lines.select("line_id", "tenant", "qty", "uom_text", "raw_text").where("line_id IS NOT NULL").join(label, "line_id").distinct()
    found = quantities(wanted).join(label, "line_id")
    units = item_units(catalogue)

    words = found.select("spelling").union(units.select("spelling")).union(units.select(F.col("stock").alias("spelling")))
    alias = unit_aliases(words)
    told = (
        units.join(alias, "spelling", "left").withColumnRenamed("unit", "told")
        .join(alias.select(F.col("spelling").alias("stock"), F.col("unit").alias("stock_unit")), "stock", "left")
        .groupBy("tenant", "item_code")
        .agg(
            F.max("item_name").alias("item_name"), F.max("stock_unit").alias("stock_unit"),
            F.filter(F.collect_set(F.struct("told", "factor")), lambda c: c["told"].isNotNull() & (c["factor"] > 0)).alias("told"),
        )
    )
    rows = found.join(alias, "spelling", "left").join(told, ["tenant", "item_code"])

    def per(unit: Column) -> Column:
        """Stock units in one unit, by the item itself."""
        own = F.array_max(F.transform(F.filter("told", lambda c: c["told"] == unit), lambda c: c["factor"]))
        return F.when(unit == F.col("stock_unit"), 1.0).otherwise(own)

    piece = per(F.lit("piece"))
    measured = F.lit(None).cast("double")
    for unit, (base, many) in MEASURES.items():
        measured = F.when(F.col("unit") == unit, per(F.lit(base)) * many).otherwise(measured)
    nothing_written = F.col("spelling").isNull() & ~F.col("unread")
    direct = F.when(nothing_written, 1.0).otherwise(F.coalesce(per(F.col("unit")), measured))
    packed = F.coalesce(F.col("pack") * piece, F.when(F.col("unit") == F.col("stock_unit"), 1.0))
    holder = ~F.col("unit").isin("piece", *MEASURES)
    factor = F.when(F.col("pack").isNotNull() & holder, packed).otherwise(direct)

    # a size of the item's name is no quantity, unless the text has it once more
    own_size = F.array_contains(measures_in(F.col("item_name")), F.col("run"))
    times = F.size(F.filter(measures_in(F.col("text")), lambda r: r == F.col("run")))
    size_only = (F.col("run") != "") & own_size & (times < 2)
    known = rows.select("line_id", "place", (F.col("number") * factor * 1000).alias("milli"), size_only.alias("size_only"), F.col("unit").isNull().alias("odd"), "run", "number")
    # in free text a run with an unknown unit is no quantity, and the next place counts;
    # conditions inside the aggregate: as filters they would be pushed down and computed twice
    usable = F.col("number").isNotNull() & ~F.col("size_only") & ~(F.col("odd") & F.col("run").rlike("[a-z]"))
    best = known.groupBy("line_id").agg(F.min_by("milli", F.when(usable, F.col("place"))).alias("milli"))
    return best.where("milli IS NOT NULL").select("line_id", F.floor(F.round("milli", 6) + 0.5).cast("long").alias("qty_milli"))

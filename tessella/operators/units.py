"""Quantities recorded in different units: a hidden Markov model per device, with the unit as hidden state.

A device is what is measured again and again: a row label and a quantity. Its readings, in the order of their tables,
are what the model sees: a value, and the unit that the cell, the column or the caption states, if any does. Hidden is
the unit that the value is in. Behind the readings stands a level, in the common unit, that seldom jumps: passing from
one unit to another is cheap where the value jumps by as much as the units differ, and dear where the level would
jump. A stated unit weighs as much as the trust in the place that states it: a unit in the cell itself outweighs any
jump, one of a header, a column or a caption gives way where the level before and after it agrees on another. Where
nothing states a unit, Viterbi's path says which one explains the value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import materialise

# Units by quantity: name, size in the quantity's base unit, offset, spellings. The base units are those
# of the SI, the litre for volumes. Gallons are US gallons, 1 kcal is 4184 J, 1 mmHg is 133.322387 Pa.
UNITS = {
    "pressure": [
        ("Pa", 1.0, 0.0, "Pa pascal pascals"),
        ("kPa", 1e3, 0.0, "kPa KPA kpa"),
        ("bar", 1e5, 0.0, "bar"),
        ("mbar", 100.0, 0.0, "mbar"),
        ("hPa", 100.0, 0.0, "hPa"),
        ("atm", 101325.0, 0.0, "atm"),
        ("mmHg", 133.322387, 0.0, "mmHg"),
        ("psi", 6894.757293168, 0.0, "psi PSI"),
    ],
    "volume": [
        ("L", 1.0, 0.0, "L l litre litres liter liters"),
        ("mL", 1e-3, 0.0, "mL ml cc"),
        ("m3", 1e3, 0.0, "m3 m^3 m³"),
        ("US gal", 3.785411784, 0.0, "US~gal US~gallon US~gallons gal gallons"),
    ],
    "temperature": [
        ("K", 1.0, 0.0, "K kelvin kelvins"),
        ("°C", 1.0, 273.15, "°C degC C ℃ Celsius"),
        ("°F", 5 / 9, 459.67 * 5 / 9, "°F degF F ℉ Fahrenheit"),
    ],
    "speed": [
        ("m/s", 1.0, 0.0, "m/s m·s⁻¹ m~s-1"),
        ("km/h", 1 / 3.6, 0.0, "km/h kph"),
        ("mph", 0.44704, 0.0, "mph"),
        ("kn", 1852 / 3600, 0.0, "kn knot knots"),
        ("cm/s", 0.01, 0.0, "cm/s"),
    ],
    "mass": [
        ("kg", 1.0, 0.0, "kg kgs KG kilogram kilograms"),
        ("g", 1e-3, 0.0, "g gm gram grams"),
        ("mg", 1e-6, 0.0, "mg milligram milligrams"),
        ("µg", 1e-9, 0.0, "µg μg mcg"),
        ("lb", 0.45359237, 0.0, "lb lbs pound pounds"),
        ("oz", 0.028349523125, 0.0, "oz ounce ounces"),
        ("t", 1e3, 0.0, "t tonne tonnes"),
    ],
    "energy": [
        ("J", 1.0, 0.0, "J joule joules"),
        ("kJ", 1e3, 0.0, "kJ"),
        ("MJ", 1e6, 0.0, "MJ"),
        ("kcal", 4184.0, 0.0, "kcal"),
        ("Wh", 3600.0, 0.0, "Wh"),
        ("kWh", 3.6e6, 0.0, "kWh kwh"),
    ],
    "length": [
        ("m", 1.0, 0.0, "m metre metres meter meters"),
        ("cm", 0.01, 0.0, "cm centimetre centimetres centimeters"),
        ("mm", 1e-3, 0.0, "mm millimetre millimetres millimeters"),
        ("km", 1e3, 0.0, "km kilometre kilometres kilometers"),
        ("in", 0.0254, 0.0, "in inch inches"),
        ("ft", 0.3048, 0.0, "ft foot feet"),
        ("yd", 0.9144, 0.0, "yd yard yards"),
    ],
    "duration": [
        ("s", 1.0, 0.0, "s sec second seconds"),
        ("ms", 1e-3, 0.0, "ms"),
        ("min", 60.0, 0.0, "min minute minutes"),
        ("h", 3600.0, 0.0, "h hr hour hours"),
        ("d", 86400.0, 0.0, "d day days"),
    ],
}
#: Values given in two units at once are in a unit of their own, sized as its first part.
PAIRED = {"length": [("ft+in", "ft", "in")], "mass": [("lb+oz", "lb", "oz")], "duration": [("h+min", "h", "min")]}
#: What a header or caption calls a quantity, as a pattern on lower-case text.
HEADERS = {"pressure": "pressure", "volume": "volume", "temperature": "temp", "speed": "speed", "mass": "mass", "energy": "energ", "length": "length|span|depth", "duration": "duration|time"}
QUANTITIES = tuple(UNITS)
#: name, size, offset of a quantity's states; the paired ones last
STATES = {q: [u[:3] for u in UNITS[q]] + [(p, *next(u[1:3] for u in UNITS[q] if u[0] == a)) for p, a, _ in PAIRED.get(q, [])] for q in QUANTITIES}
WIDEST = max(map(len, STATES.values()))


def _lookup() -> Column:
    """Spelling to "quantity|unit"."""
    pairs = [(s.replace("~", " "), f"{q}|{u[0]}") for q in QUANTITIES for u in UNITS[q] for s in u[3].split()]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def _in_base(quantity: Column, unit: Column, value: Column) -> Column:
    size = F.create_map(*[F.lit(x) for q in QUANTITIES for u in STATES[q] for x in (f"{q}|{u[0]}", u[1])])
    offset = F.create_map(*[F.lit(x) for q in QUANTITIES for u in STATES[q] for x in (f"{q}|{u[0]}", u[2])])
    key = F.concat_ws("|", quantity, unit)
    return value * F.try_element_at(size, key) + F.try_element_at(offset, key)


# The notations of numbers in cells.
SIGNED = r"^\s*(?:ca\.|≈|~)?\s*([-−+]?\d[\d.,]*)(?:[eE]([-+]?\d{1,3})|\s*[×x]\s*10\^([-+]?\d{1,3}))?"
UNCERTAIN = r"(?:\s*(?:±|\+/-)\s*[\d.,]+(?:[eE][-+]?\d{1,3})?)?"
READING = SIGNED + UNCERTAIN + r"\s*(.*?)\s*$"
TWO_UNITS = r"^\s*([\d.]+)\s*([A-Za-z]+)\s+([\d.]+)\s*([A-Za-z]+)\s*$"
GROUPED = r"^[-−+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"
SURELY_GROUPED = r"^[-−+]?\d{1,3}(?:,\d{3})+(?:,\d{3}|\.\d+)$"


def quantity_of(header: Column) -> Column:
    lower = F.lower(header)
    out = F.lit(None).cast("string")
    for q in reversed(QUANTITIES):
        out = F.when(lower.rlike(HEADERS[q]), F.lit(q)).otherwise(out)
    return out


def _unit(spelling: Column, quantity: Column) -> Column:
    """The unit's name if the spelling is one of the quantity's."""
    found = F.try_element_at(_lookup(), F.trim(spelling))
    return F.when(F.split_part(found, F.lit("|"), F.lit(1)) == quantity, F.split_part(found, F.lit("|"), F.lit(2)))


def column_units(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, column_index, quantity, header_unit, column_unit, caption_unit of the columns that hold a quantity."""
    captions = tables.select(F.col("id").alias("table_id"), "caption").dropDuplicates(["table_id"])
    cols = columns.select("table_id", "column_index", "raw_header", "inferred_unit").dropDuplicates(["table_id", "column_index"])
    cols = cols.withColumn("quantity", quantity_of(F.col("raw_header"))).where("quantity is not null").join(captions, "table_id", "left")
    in_header = F.regexp_extract("raw_header", r"^.*(?:[(\[]|, | in |_)\s*([^()\[\]]+?)\s*[)\]]?$", 1)
    # a caption's notes: "; masses in kg, speeds in mph"
    noted = F.filter(F.split(F.regexp_extract("caption", r";\s*([^;]*)$", 1), r",\s*"), lambda x: quantity_of(F.split_part(x, F.lit(" in "), F.lit(1))) == F.col("quantity"))
    in_caption = F.split_part(F.try_element_at(noted, F.lit(1)), F.lit(" in "), F.lit(2))
    q = F.col("quantity")
    return cols.select("table_id", "column_index", "quantity", _unit(in_header, q).alias("header_unit"), _unit(F.col("inferred_unit"), q).alias("column_unit"), _unit(in_caption, q).alias("caption_unit"))


def readings(cells: DataFrame, columns: DataFrame, tables: DataFrame, label_column: int = 0) -> DataFrame:
    """cell_id, table_id, label, quantity, value, unit, source, at: every cell that holds a number of some quantity.

    A comma is a decimal point where its column has commas that can be nothing else, else it groups digits. Numbers
    are parsed where cells are scanned; what is shuffled, once and by table and row, is the parsed reading and the
    label of its row, so that no table, however long, is one task's.
    """
    rows = cells.where("row_index > 0").select(F.col("id").alias("cell_id"), "table_id", "row_index", "column_index", "raw_value", "unit")
    commas = rows.where((F.col("column_index") != label_column) & F.col("raw_value").contains(",")).select("table_id", "column_index", F.regexp_extract("raw_value", SIGNED, 1).alias("number")).where(F.col("number").contains(","))
    decimal = commas.groupBy("table_id", "column_index").agg(F.max(~F.col("number").rlike(GROUPED)).alias("d"), F.max(F.col("number").rlike(SURELY_GROUPED)).alias("g"))
    decimal = decimal.where("d and not g").select("table_id", "column_index", F.lit(True).alias("comma_is_point"))
    at = tables.select(F.col("id").alias("table_id"), F.col("created_at").alias("at")).dropDuplicates(["table_id"])
    known = column_units(columns, tables).join(decimal, ["table_id", "column_index"], "left").join(at, "table_id", "left")
    # written, so that the planner knows its size and broadcasts it only if that is small
    known = materialise(known, "columns")
    is_label = F.col("column_index") == label_column
    body = rows.join(known, ["table_id", "column_index"], "left").where(is_label | F.col("quantity").isNotNull())
    # one pass of the pattern: its groups, parted by a character that no cell has
    body = body.withColumn("_p", F.split(F.regexp_replace("raw_value", READING, "$1\x01$2\x01$3\x01$4"), "\x01"))
    body = body.withColumn("number", F.get("_p", F.lit(0))).withColumn("power", F.concat(F.get("_p", F.lit(1)), F.get("_p", F.lit(2)))).withColumn("said", F.get("_p", F.lit(3)))
    point = F.col("comma_is_point") | ~F.col("number").rlike(GROUPED)
    plain = F.when(~F.col("number").contains(","), F.col("number")).when(point, F.replace("number", F.lit(","), F.lit("."))).otherwise(F.replace("number", F.lit(","), F.lit("")))
    q = F.col("quantity")
    # columns, not expressions, so that each is computed once
    body = body.withColumn("plain", F.replace(plain, F.lit("−"), F.lit("-")).try_cast("double")).withColumn("in_cell", _unit(F.when(F.col("said") == "", F.col("unit")).otherwise(F.col("said")), q))
    two = F.when(F.col("in_cell").isNull() & F.col("said").rlike(r"\s\d"), F.split(F.regexp_replace("raw_value", TWO_UNITS, "$1\x01$2\x01$3\x01$4"), "\x01"))
    body = body.withColumn("_two", F.when(F.size(two) == 4, two)).withColumn("_pair", F.when(F.col("_two").isNotNull(), F.concat_ws("+", _unit(F.col("_two")[1], q), _unit(F.col("_two")[3], q))))
    body = body.withColumn("paired", F.coalesce(F.col("_pair").isin(*[p for ps in PAIRED.values() for p, _, _ in ps]), F.lit(False)))
    ratio = F.create_map(*[F.lit(x) for k, ps in PAIRED.items() for p, a, b in ps for x in (p, next(u[1] for u in UNITS[k] if u[0] == b) / next(u[1] for u in UNITS[k] if u[0] == a))])
    whole = F.col("_two")[0].try_cast("double") + F.col("_two")[2].try_cast("double") * F.try_element_at(ratio, F.col("_pair"))
    value = F.when(F.col("paired"), whole).otherwise(F.col("plain") * F.pow(F.lit(10.0), F.coalesce(F.nullif("power", F.lit("")).try_cast("int"), F.lit(0))))
    stated = F.coalesce("in_cell", "header_unit", "column_unit", "caption_unit")
    unknown = (F.col("said") != "") & F.col("in_cell").isNull()
    body = body.select(
        "cell_id",
        "table_id",
        "row_index",
        "column_index",
        F.when(is_label, F.nullif(F.trim("raw_value"), F.lit(""))).alias("_label"),
        "quantity",
        "at",
        F.when(~is_label, value).alias("value"),
        F.when(F.col("paired"), F.col("_pair")).when(~unknown, stated).alias("unit"),
        F.when(F.col("paired") | F.col("in_cell").isNotNull(), "cell").when(unknown, "unknown").when(F.col("header_unit").isNotNull(), "header").when(F.col("column_unit").isNotNull(), "column").when(F.col("caption_unit").isNotNull(), "caption").otherwise("decoded").alias("source"),
    )
    row = Window.partitionBy("table_id", "row_index")
    body = body.withColumn("_n", F.row_number().over(Window.partitionBy("table_id", "row_index", "column_index", "cell_id").orderBy("value"))).withColumn("label", F.max("_label").over(row))
    # text behind a number that is no unit of the quantity makes no reading; asked here, where all is worked out
    return body.where((F.col("_n") == 1) & F.col("label").isNotNull() & ~is_label & F.col("value").isNotNull() & (F.col("source") != "unknown")).select("cell_id", "table_id", "label", "quantity", "value", "unit", "source", "at")


def viterbi(devices: np.ndarray, quantities: np.ndarray, values: np.ndarray, stated: np.ndarray, stay: float = 0.6, scale: float = 0.05, most: float = 8.0, trust: float | np.ndarray = 60.0) -> np.ndarray:
    """The state of each reading; readings stand in order of (device, time), stated is -1 where nothing is stated.

    All devices are decoded at once, position by position. A level's jump costs |log ratio| / scale, most at most. A
    state other than the stated one costs trust, one value or one for each reading: above some 2 * (most + 2.5), what
    a reading's two jumps and two moves can weigh at most, a label stands whatever the level says.
    """
    n = len(devices)
    if not n:
        return np.zeros(0, dtype=np.int64)
    sizes = np.ones((len(QUANTITIES), WIDEST))
    offsets = np.zeros((len(QUANTITIES), WIDEST))
    open_ = np.zeros((len(QUANTITIES), WIDEST), dtype=bool)  # states that need not be stated
    for i, q in enumerate(QUANTITIES):
        for j, (_, size, offset) in enumerate(STATES[q]):
            sizes[i, j], offsets[i, j], open_[i, j] = size, offset, j < len(UNITS[q])
    amount = values[:, None] * sizes[quantities] + offsets[quantities]
    with np.errstate(divide="ignore", invalid="ignore"):
        level = np.where(amount > 0, np.log(amount), np.nan)
    emit = np.where(open_[quantities], -np.log(open_.sum(1))[quantities][:, None], -1e6)
    emit = np.where((stated >= 0)[:, None], np.where(np.arange(WIDEST)[None, :] == stated[:, None], 0.0, -np.broadcast_to(trust, n)[:, None]), emit)
    starts = np.flatnonzero(np.r_[True, devices[1:] != devices[:-1]])
    lengths = np.diff(np.r_[starts, n])
    move = np.where(np.eye(WIDEST, dtype=bool), np.log(stay), np.log((1 - stay) / WIDEST))
    back = np.zeros((n, WIDEST), dtype=np.int8)
    score = np.zeros((n, WIDEST))
    score[starts] = emit[starts]
    for t in range(1, int(lengths.max())):
        at = starts[lengths > t] + t
        jump = np.abs(level[at][:, None, :] - level[at - 1][:, :, None]) / scale
        jump = np.where(np.isnan(jump), most / 2, np.minimum(jump, most))
        ways = score[at - 1][:, :, None] + move[None] - jump
        back[at] = ways.argmax(1)
        score[at] = ways.max(1) + emit[at]
    out = np.zeros(n, dtype=np.int64)
    ends = starts + lengths - 1
    out[ends] = score[ends].argmax(1)
    for t in range(int(lengths.max()) - 1, 0, -1):
        at = starts[lengths > t] + t
        out[at - 1] = back[at, out[at]]
    return out


#: What a unit weighs against the level, by the place that states it. One in the cell itself can't be outweighed.
TRUST = {"cell": 60.0, "header": 16.0, "column": 13.0, "caption": 13.0}
#: The order of table_cells' statement: whatever is stated stands.
STATED_STANDS = dict.fromkeys(TRUST, 60.0)


def _decoded(batches: Iterator[pd.DataFrame], trust: dict[str, float]) -> Iterator[pd.DataFrame]:
    number = {q: i for i, q in enumerate(QUANTITIES)}
    state = {(q, s[0]): j for q in QUANTITIES for j, s in enumerate(STATES[q])}
    table = np.empty((len(QUANTITIES), WIDEST), dtype=object)
    size, offset = np.ones(table.shape), np.zeros(table.shape)
    for i, q in enumerate(QUANTITIES):
        for j, s in enumerate(STATES[q]):
            table[i, j], size[i, j], offset[i, j] = s
    carry: pd.DataFrame | None = None

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        quantities = rows["quantity"].map(number).to_numpy()
        stated = np.array([state.get((q, u), -1) for q, u in zip(rows["quantity"], rows["unit"], strict=True)], dtype=np.int64)
        weights = rows["source"].map(trust).fillna(0.0).to_numpy(dtype=float)
        devices = pd.factorize(rows["label"] + "\x01" + rows["quantity"] + "\x01" + rows["part"].astype(str))[0]
        path = viterbi(devices, quantities, rows["value"].to_numpy(dtype=float), stated, trust=weights)
        out = rows[["cell_id", "table_id", "label", "quantity", "value"]].copy()
        overruled = (stated >= 0) & (path != stated)
        out["source"] = np.where(overruled, "overruled", rows["source"])
        out["unit"], out["stated_unit"] = table[quantities, path], rows["unit"]
        out["amount"] = rows["value"].to_numpy() * size[quantities, path] + offset[quantities, path]
        return out[rows["core"].to_numpy(dtype=bool)]

    for batch in batches:
        rows = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
        if len(rows):
            last = (rows[["label", "quantity", "part"]] == rows[["label", "quantity", "part"]].iloc[-1]).all(axis=1)
            carry = rows[last]
            if not last.all():
                yield work(rows[~last])
    if carry is not None and len(carry):
        yield work(carry)


def stretches(rows: DataFrame, stretch: int, overlap: int) -> DataFrame:
    """rows with part and core: devices of more than stretch readings cut, in the order of time, into parts of stretch.

    A part has, besides its own readings (core), the overlap readings before and after it, so that its path is the one
    that the whole device has there: what lies further off has no say once paths have met. Places come from a range
    partition of the long devices' readings and the counts of the ranges before; no device is gathered.
    """
    one = [F.lit(0).alias("part"), F.lit(True).alias("core")]
    long = rows.groupBy("label", "quantity").agg(F.count("*").alias("_n")).where(F.col("_n") > stretch).select("label", "quantity")
    long = materialise(long, "long-devices")
    if not long.take(1):
        return rows.select("*", *one)
    order = ("label", "quantity", "at", "table_id", "cell_id")
    cut = rows.join(long, ["label", "quantity"], "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    cut = materialise(cut.withColumn("_id", F.monotonically_increasing_id()), "long-readings").withColumn("_range", F.shiftright("_id", 33))
    ranges = cut.groupBy("label", "quantity", "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("label", "quantity").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("label", "quantity", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = cut.join(ranges, ["label", "quantity", "_range"]).withColumn("_at", F.col("_before") + F.col("_id") - F.col("_first"))
    first = F.greatest(F.floor((F.col("_at") - overlap) / stretch), F.lit(0))
    placed = placed.withColumn("part", F.explode(F.sequence(first.cast("int"), F.floor((F.col("_at") + overlap) / stretch).cast("int"))))
    placed = placed.withColumn("core", F.floor(F.col("_at") / stretch) == F.col("part"))
    return rows.join(long, ["label", "quantity"], "left_anti").select("*", *one).unionByName(placed.select(*rows.columns, "part", "core"))


def common_amounts(cells: DataFrame, columns: DataFrame, tables: DataFrame, targets: DataFrame, label_column: int = 0, stretch: int = 5000, overlap: int = 250, trust: dict[str, float] | None = None) -> DataFrame:
    """cell_id, table_id, label, quantity, value, unit, stated_unit, source, amount, common_unit of every reading.

    cells, columns and tables have the columns of table_cells, table_columns and typed_tables; targets says the common
    unit of each quantity (a quantity without one keeps the base unit). Other columns are ignored. unit is the state
    that Viterbi's path gives the reading. source says where it stands: cell, header, column, caption; decoded where
    nothing states a unit and the model supplies it; overruled where the level outweighs stated_unit.

    - A repeated row counts once. Cells that are null, missing marks or text, of columns that hold no quantity, or of
      rows without a label are no readings; so are numbers followed by something that is no unit of the quantity.
    - Of a value with an uncertainty the main value counts.
    - trust is what a stated unit weighs, by source (TRUST; STATED_STANDS lets no label be outweighed).
    - A device of more than stretch readings is decoded in stretches in the order of time, each with overlap readings
      on either side, so that no task holds an unbounded one. A value that has no logarithm tells nothing of the level.
    """
    trust = TRUST if trust is None else trust
    rows = materialise(readings(cells, columns, tables, label_column), "readings")
    fields = ["cell_id", "table_id", "label", "quantity", "value", "unit", "source", "part", "core"]
    by = ("label", "quantity", "part")
    ordered = stretches(rows, stretch, overlap).repartition(*by).sortWithinPartitions(*by, "at", "table_id", "cell_id").select(*fields)
    decoded = ordered.mapInPandas(lambda b: _decoded(b, trust), "cell_id string, table_id string, label string, quantity string, value double, source string, unit string, stated_unit string, amount double")
    # size and offset of each common unit are worked out once, on the few rows of targets
    q, goal = F.col("quantity"), _unit(F.col("common_unit"), F.col("quantity"))
    goals = targets.select("quantity", "common_unit").dropDuplicates(["quantity"]).withColumn("_goal", goal).where("_goal is not null")
    goals = goals.select("quantity", F.col("common_unit").alias("_named"), _in_base(q, F.col("_goal"), F.lit(0.0)).alias("_zero"), (_in_base(q, F.col("_goal"), F.lit(1.0)) - _in_base(q, F.col("_goal"), F.lit(0.0))).alias("_size"))
    if len(goals.limit(1001).take(1001)) > 1000:
        raise ValueError("too many targets to broadcast")
    out = decoded.join(F.broadcast(goals), "quantity", "left")
    amount = F.coalesce((F.col("amount") - F.col("_zero")) / F.col("_size"), "amount")
    base = F.create_map(*[F.lit(x) for k in QUANTITIES for x in (k, UNITS[k][0][0])])
    return out.select("cell_id", "table_id", "label", "quantity", "value", "unit", "stated_unit", "source", amount.alias("amount"), F.coalesce("_named", base[q]).alias("common_unit"))


def same_amount_pairs(amounts: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """cell_a < cell_b: readings of one label and quantity in different tables and units whose amounts differ by at most tolerance of the larger.

    A band join: amounts fall into buckets as wide, in logarithms, as the tolerance, and meet their own and the one
    above. Amounts of one bucket are alike, so what meets is, but for neighbours, what is found. Only devices that
    have two units and two tables take part.
    """
    width = float(-np.log(1 - tolerance)) * 1.001
    bucket = F.when(F.col("amount") == 0, F.lit(None)).otherwise(F.floor(F.log(F.abs("amount")) / width))
    rows = amounts.where("amount is not null").select("cell_id", "table_id", "label", "quantity", "unit", "amount", F.signum("amount").cast("int").alias("sign"), F.coalesce(bucket, F.lit(0)).alias("bucket"))
    rows = materialise(rows, "amounts")  # asked twice
    several = rows.groupBy("label", "quantity").agg(F.min("unit").alias("u"), F.max("unit").alias("v"), F.min("table_id").alias("s"), F.max("table_id").alias("t")).where("u <> v and s <> t")
    rows = rows.join(several.select("label", "quantity"), ["label", "quantity"], "left_semi")
    near = rows.withColumn("meets", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    a, b = rows.alias("a"), near.alias("b")
    on = F.col("a.bucket") == F.col("b.meets")
    for c in ("label", "quantity", "sign"):
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    once = (F.col("a.bucket") != F.col("b.bucket")) | (F.col("a.cell_id") < F.col("b.cell_id"))
    apart = (F.col("a.table_id") != F.col("b.table_id")) & (F.col("a.unit") != F.col("b.unit"))
    close = F.abs(F.col("a.amount") - F.col("b.amount")) <= tolerance * F.greatest(F.abs("a.amount"), F.abs("b.amount"))
    return a.join(b, on & once & apart & close).select(F.least("a.cell_id", "b.cell_id").alias("cell_a"), F.greatest("a.cell_id", "b.cell_id").alias("cell_b"))

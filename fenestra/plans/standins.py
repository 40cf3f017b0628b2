"""The driver tables in the role of take-off tables.

The given tables hold no openings, so each input of an operator is derived from
them by arithmetic on their columns: parts give sizes and kinds, order lines give
units and quantities, orders give pages, events give runs. Nothing is sampled or
cut; every derived table grows with its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fenestra.functions.geometry import box
from fenestra.operators.ordered import row_numbers


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sixteenths(n: Column) -> Column:
    return n % 16 / F.lit(16.0)


def part_kind() -> Column:
    return (F.when(F.col("p_type") == "PROMO", "door").when(F.col("p_type") == "LARGE", "composite")
            .otherwise("window"))


def panel(role, width, height, glass=None, u_factor=None, egress=None, clear=None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    pick = lambda c, t: none(t) if c is None else c.cast(t)
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"),
                    width.cast("double").alias("width_in"), height.cast("double").alias("height_in"),
                    pick(glass, "string").alias("glass"), pick(u_factor, "double").alias("u_factor"),
                    pick(egress, "boolean").alias("egress"), pick(clear, "double").alias("clear_opening_sqft"))


def panels_of(kind: Column, *values: Column) -> Column:
    """One panel; a composite also has a door panel 36 in wide of the same height."""
    main = panel(F.when(kind == "door", "door").otherwise("window"), *values)
    door = panel("door", F.lit(36.0), *values[1:])
    return F.when(kind == "composite", F.array(main, door)).otherwise(F.array(main))


def lines_with_parts(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_size", "p_brand", "p_retailprice")
    return table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def line_units(spark: SparkSession, sf: str) -> DataFrame:
    """One unit per order line; an order is a project, a supplier a source document."""
    kind = part_kind()
    glass = F.when(F.col("l_returnflag") == "A", "annealed").when(F.col("l_returnflag") == "R", "tempered")
    width = 20 + F.col("p_size") + sixteenths(F.col("l_partkey"))
    height = 40 + F.col("p_size") + sixteenths(F.col("l_suppkey"))
    egress = F.when(F.col("l_discount") > 0, F.col("l_linestatus") == "O")
    return lines_with_parts(spark, sf).select(
        F.col("l_orderkey").alias("project"), F.col("l_suppkey").alias("supplier"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("partkey"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("unit_id"), kind.alias("kind"),
        panels_of(kind, width, height, glass, 0.2 + F.col("l_tax"), egress, F.col("l_discount") * 100)
        .alias("panels"), F.col("l_quantity").cast("int").alias("qty"),
        F.array("p_brand").alias("source_marks"), F.col("p_size").alias("size"),
        F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"))


def line_projects(spark: SparkSession, sf: str) -> DataFrame:
    """The project of every row of ``line_units``, without its sizes."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project"))


def predicted_units(units: DataFrame) -> DataFrame:
    """The same units as a reader would report them: some sizes, quantities and glass are off."""
    wider = F.when(F.col("discount") == 0.05, 3.0).when(F.col("tax") == 0.02, 0.5).otherwise(0.0)
    glass = lambda p: F.when(F.col("tax") == 0.04, F.lit("mixed")).otherwise(p["glass"])
    change = lambda p: p.withField("width_in", p["width_in"] + wider).withField("glass", glass(p))
    return units.withColumn("panels", F.transform("panels", change)).withColumn(
        "qty", F.col("qty") + F.when(F.col("returnflag") == "R", 1).otherwise(0))


def part_units(spark: SparkSession, sf: str) -> DataFrame:
    """One truth unit per part; a brand is a project."""
    kind = part_kind()
    width, height = 20.0 + F.col("p_size"), 60.0 + F.col("p_partkey") % 30
    glass = F.when(F.col("p_type") == "SMALL", "annealed").otherwise("tempered")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("project"), F.col("p_partkey").cast("string").alias("unit_id"),
        kind.alias("kind"), panels_of(kind, width, height, glass, F.lit(0.24), F.lit(True), F.lit(6.5))
        .alias("panels"), (1 + F.col("p_partkey") % 60).cast("int").alias("qty"),
        F.col("p_type").alias("type"), F.col("p_size").alias("size"))


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as numbered pages of a (source, language) set; pages of one language are scans.

    A scan has text, as read from its image, but no text layer. Page numbers are made
    without the texts, which then meet them by key.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    text = (F.when(F.col("lang") == "fr", F.concat(F.lit("WINDOW SCHEDULE\n"), "text"))
            .when(F.col("lang") == "de", F.concat(F.lit("Rough Opening / Mark\n"), "text"))
            .when(F.col("n_chars") > 2000, F.concat("text", F.lit("\nWeather  Shield"))).otherwise(F.col("text")))
    name, key = F.concat_ws("-", "source", "lang").alias("doc_id"), F.col("doc_id").alias("page_key")
    numbers = row_numbers(docs.select(name, key), ["doc_id"], [F.col("page_key")], "page_no").select("page_key", "page_no")
    named = docs.select(name, key, text.alias("text"), "n_chars", F.coalesce(F.col("lang") == "es", F.lit(False)).alias("scanned"))
    return named.join(numbers, "page_key")


def branch_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of ``document_pages`` with an offer, level datums, a reading and a schedule row each, by arithmetic."""
    k, n, page = F.col("page_key"), F.col("n_chars"), F.col("page_no")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    unit, qty = 100 + k % 50, 1 + n % 5
    offer = F.concat_ws("\n", F.lit("Profile: P"), text("Frame size: ", 30 + n % 600, " x ", 60 + k % 40), F.lit("Glass TEMP"),
                        F.lit("Egress: NO"), k.cast("string"), F.lit("1,000.00"), F.lit("-"), _money(unit.cast("double")), F.lit("-"),
                        qty.cast("string"), _money((unit * qty + F.when(k % 9 == 0, 10).otherwise(0)).cast("double")), F.lit("9.00"),
                        F.lit("Accessories"), F.repeat(F.lit("First Level "), (1 + n % 5).cast("int")))
    answer = F.when(k % 6 == 0, "nothing to be read").otherwise(text(
        'Page read: {"readable":true,"confidence":"', F.when(n % 3 == 0, "medium").otherwise("high"), '","units":[{"mark":"M', page,
        '","width_in":', n / 4, ',"qty":', F.when(n % 2 == 0, "null").otherwise("3"), "}]}"))
    row = F.struct(text("m", k).alias("mark"), F.when(k % 4 == 0, "n/a").otherwise(text(2 + k % 3, "0", 5 + n % 2, "0")).alias("size_code"),
                   qty.cast("string").alias("qty"), F.when(k % 5 == 0, "Door").otherwise("window").alias("type"))
    return document_pages(spark, sf).select("doc_id", "page_no", offer.alias("text"), answer.alias("raw_text"), F.array(row).alias("rows"))


def page_votes(spark: SparkSession, sf: str, pages: DataFrame) -> DataFrame:
    labels = table(spark, sf, "labels").withColumn(
        "vote", F.when(F.col("toxic") == 1, "HANDWRITTEN").when(F.col("quality") == 0, "TABLE").otherwise("PLAN"))
    return pages.join(labels.select(F.col("doc_id").alias("page_key"), "vote"), "page_key").select(
        "doc_id", "page_no", "vote")


def elevation_text_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Document text with common words replaced by drawing words."""
    text = F.col("text")
    for word, with_ in (("the", "First Level"), (" and ", " elevation "), ("re", "t.o. parapet"), ("es", "second level")):
        text = F.replace(text, F.lit(word), F.lit(with_))
    return table(spark, sf, "documents").select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), text.alias("text"))


def _money(v: Column) -> Column:
    return F.format_number(v, 2)


def offer_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One printed offer page per order: one to three sub-units and a price line, then one more of each."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def block(j: int, ro: bool) -> Column:
        lines = [F.lit("Profile: P"), F.concat(F.lit("Frame size: "), (30 + key % 50 + j).cast("string"), F.lit(" "),
                                              (1 + cust % 15).cast("string"), F.lit('/16" x '),
                                              (60 + key % 40).cast("string"), F.lit(' 1/2"'))]
        if ro:
            lines.append(F.concat(F.lit("Rough opening: "), (31 + key % 50).cast("string"), F.lit(" x "),
                                  (61 + key % 40).cast("string")))
        lines.append(F.when(F.col("o_orderstatus") == "P", "Glass TEMP outside ANN inside")
                     .when(F.col("o_orderstatus") == "F", "Glass TEMP").otherwise("Glass clear"))
        lines.append(F.when(cust % 2 == 0, "Egress: YES").otherwise("Egress: NO"))
        return F.concat_ws("\n", *lines)

    def price(item: Column, unit: Column, qty: Column, total: Column) -> Column:
        return F.concat_ws("\n", item.cast("string"), F.lit("1,000.00"), F.lit("-"), _money(unit), F.lit("-"),
                           qty.cast("string"), _money(total), F.lit("9.00"), F.lit("Accessories"))

    unit = F.floor(F.col("o_totalprice")).cast("double") / 4
    qty, off = 1 + cust % 60, F.when(key % 7 == 0, 10.0).otherwise(0.0)
    first = F.array_join(F.slice(F.array(*[block(j, j == 0) for j in range(3)]), F.lit(1), (1 + key % 3).cast("int")), "\n")
    text = F.concat_ws("\n", first, price(key, unit, qty, unit * qty + off), block(9, True),
                       price(key + 1, F.lit(2500.5), F.lit(2), F.lit(5001.0)))
    return table(spark, sf, "orders").select(cust.alias("doc_id"), key.alias("page_no"), text.alias("text"))


def unit_responses(spark: SparkSession, sf: str) -> DataFrame:
    """A model response per order line, in each accepted wrapping and one that cannot be read."""
    width = F.concat((20 + F.col("p_size")).cast("string"), F.lit(" "), (F.col("l_partkey") % 16).cast("string"),
                     F.lit("/16"))
    width = F.concat(F.lit('"'), width, F.lit('"'))
    unit = F.concat(
        F.lit('{"unit_id":"'), F.col("l_partkey"), F.lit('","kind":"window","panels":[{"role":"window","width_in":'), width,
        F.lit(',"height_in":'), (40 + F.col("p_size")), F.lit(".5"),
        F.lit(',"glass":"tempered","egress":'), F.when(F.col("l_linestatus") == "O", "true").otherwise("null"),
        F.lit('}],"qty":'), F.col("l_quantity").cast("int"),
        F.lit(',"evidence":[{"page":0,"region":"schedule","bbox":['), F.col("l_suppkey"), F.lit(",10,20,30]}]}"))
    form = F.col("l_linenumber")
    text = (F.when(form == 1, F.concat(F.lit("["), unit, F.lit("]")))
            .when(form == 2, F.concat(F.lit("```json\n["), unit, F.lit(',"junk"]\n```')))
            .when(form == 3, F.concat(F.lit('{"units":['), unit, F.lit("]}")))
            .when(form == 4, F.concat(F.lit('{"data":['), unit, F.lit("]}")))
            .when(form == 5, unit)
            .when(form == 6, F.concat(F.lit("The list is: ["), unit, F.lit(',{"panels":[]}] as seen [1].')))
            .otherwise(F.concat(F.lit("cannot read ["), F.replace(unit, F.lit(":"), F.lit(" ")))))
    return lines_with_parts(spark, sf).select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"),
        F.lit(0).alias("region_no"), F.lit(None).cast("string").alias("error"), text.alias("raw_text"),
        F.col("l_suppkey").alias("x"))


def order_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One drawing page per order; scanned where the order is still open."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), key.alias("page_no"), F.repeat("o_orderpriority", 12).alias("text"),
        F.when(F.col("o_orderstatus") == "O", 2).otherwise(20).alias("n_drawings"),
        (3000 + key % 5 * 700).cast("int").alias("width_px"), (2000 + key % 3 * 900).cast("int").alias("height_px"))


def order_regions(pages: DataFrame) -> DataFrame:
    """Three boxes per page, one of them too small to be a drawing region."""
    spot = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    k = F.col("page_no")
    boxes = F.array(spot(1000 + k % 400, 400 + k % 90, F.lit(900), F.lit(600)),
                    spot(100 + k % 300, 410 + k % 70, F.lit(700), F.lit(500)),
                    spot(F.lit(5), F.lit(5), F.lit(70), F.lit(60)))
    return pages.select("doc_id", "page_no", F.explode(boxes).alias("b")).select("doc_id", "page_no", "b.*")


def crop_responses(pages: DataFrame, sources: bool = False) -> DataFrame:
    """Two cropped responses per page, each with one unit; with ``sources`` one per agent."""
    k = F.col("page_no")
    crops = pages.withColumn("region_no", F.explode(F.array(F.lit(1), F.lit(2))))
    agents = F.array(*[F.lit(s) for s in ("schedule", "elevation", "plan", "notes")])
    if sources:
        # an open page was not read by the schedule agent
        seen = F.when(F.col("n_drawings") == 2, F.slice(agents, 2, 3)).otherwise(agents)
        crops = crops.withColumn("source", F.explode(seen))
    size = F.when(F.col("region_no") == 1, 30 + k % 20).otherwise(50 + k % 10)
    extra = (F.length("source") * (k % 2)).cast("int") if sources else F.lit(0)
    unit = F.concat(F.lit('[{"unit_id":"W'), size, F.lit('","panels":[{"width_in":'), size, F.lit(',"height_in":"60 1/2","glass":"annealed"}],"qty":'),
                    (1 + k % 9 + extra), F.lit(',"source_marks":["W'), size, F.lit('"],"evidence":[{"bbox":[1,2,3,4]}]}]'))
    keep = ["doc_id", "page_no", "region_no"] + (["source"] if sources else [])
    return crops.select(*keep, F.lit(None).cast("string").alias("error"), unit.alias("raw_text"))


def coarse_responses(pages: DataFrame) -> DataFrame:
    """A coarse reading per page: two regions, one of them too small, in fractions of the page."""
    share = F.concat(F.lit("0."), (1 + F.col("page_no") % 3).cast("string"))
    text = F.concat(F.lit('[{"region":"plan","bbox_pct":['), share, F.lit(",0.25,0.5,0.5]},"
                    '{"region":"plan","bbox_pct":[0.1,0.1,0.001,0.5]}]'))
    return pages.select("doc_id", "page_no", F.lit(None).cast("string").alias("error"), text.alias("raw_text"))


def schedule_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A schedule table per order: a heading row and one row per order line, cell by cell."""
    lines = row_numbers(lines_with_parts(spark, sf), ["l_orderkey"], [
        F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")], "row_no", bound_by=table(spark, sf, "lineitem"))
    size = F.concat((20 + F.col("p_size")).cast("string"), F.lit(" "), (1 + F.col("l_partkey") % 15).cast("string"),
                    F.lit("/16 X "), (40 + F.col("p_size")).cast("string"))
    glass = F.when(F.col("l_returnflag") == "A", "ANN.").when(F.col("l_returnflag") == "R", "Tempered").otherwise("")
    cells = F.array(size, F.concat(F.when(F.col("l_linestatus") == "O", "d").otherwise("W"), F.col("l_partkey")), glass,
                    F.concat(F.format_string("%.2f", 0.2 + F.col("l_tax")), F.lit(" max")),
                    F.when(F.col("l_discount") > 0.05, "Y").when(F.col("l_discount") > 0.02, "X").otherwise("no"),
                    F.col("l_quantity").cast("int").cast("string"))
    body = lines.select("l_orderkey", "row_no", F.posexplode(cells).alias("col_no", "text"))
    heads = F.array(*[F.lit(h) for h in ("Size", " Mark ", "GLASS", "U-Factor", "Egress", "Qty")])
    top = table(spark, sf, "lineitem").select("l_orderkey").distinct().select(
        "l_orderkey", F.lit(0).cast("bigint").alias("row_no"), F.posexplode(heads).alias("col_no", "text"))
    return top.unionByName(body).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"),
                                        F.lit(0).alias("table_no"), "row_no", "col_no", "text")


def schedule_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The document of every row of ``schedule_cells``, without its cells."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"))


def schedule_rows(spark: SparkSession, sf: str, reader: str = "a") -> DataFrame:
    """Transcribed schedule rows per order; reader ``b`` disagrees on some."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    quad = F.concat((2 + k % 3), (k % 10), (5 + k % 3), (c % 10))
    code = F.when(c % 4 == 0, F.concat(F.lit("2-"), quad)).when(c % 4 == 1, F.concat(F.lit("2'-"), k % 10, F.lit("\" x 6'-0\""))).when(
        c % 4 == 2, quad).otherwise(F.lit("n/a"))
    qty = 1 + k % 12
    if reader == "b":
        code = F.when(F.col("o_orderstatus") == "P", F.lit("2870")).otherwise(F.replace(code, F.lit("-"), F.lit(" - ")))
        qty = qty + F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    kind = F.when(k % 5 == 0, "Door").otherwise("window")
    return table(spark, sf, "orders").select(
        c.alias("project"), F.concat(F.lit("m"), k.cast("string")).alias("mark"), code.alias("size_code"),
        qty.cast("string").alias("qty"), kind.alias("type"))


def transcript(spark: SparkSession, sf: str, source: str) -> DataFrame:
    """One transcript row per order with headings in the style of the source."""
    first = source == "a"
    cells = F.create_map(
        F.lit("#" if first else "MARK"), F.concat(F.lit(" k" if first else "K"), F.col("o_orderkey").cast("string")),
        F.lit("WINDOW SIZE" if first else "Window Size"), F.col("o_custkey").cast("string"),
        F.lit("QTY" if first else "QTY."), F.col("o_orderstatus") if first else F.when(
            F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")),
        F.lit("DAY OPEN (SF)" if first else "Day Open"), F.col("o_orderpriority"))
    rows = table(spark, sf, "orders")
    if not first:  # the second reader missed the rows of the cheapest orders
        rows = rows.where("o_totalprice >= 50000")
    return rows.select(cells.alias("cells"), F.col("o_orderkey").alias("row_no"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as result rows of benchmark runs; the time stands for the file time."""
    k = F.get_json_object("props", "$.k").cast("int")
    letter = F.substring(F.lit("ABCDEFG"), (1 + F.col("user_id") % 7).cast("int"), F.lit(1))
    return table(spark, sf, "events").select(
        letter.alias("variant"), F.col("event_type").alias("model"),
        F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project"),
        F.when(k % 3 == 0, "offer").otherwise("extraction").alias("gt_level"),
        (k / F.lit(100.0)).alias("group_f1"), (F.col("value") / 1000).alias("unit_count_error"),
        F.when(k % 5 != 0, k / F.lit(10.0)).alias("qty_mae"), (F.col("value") / 100).alias("cost_usd"),
        F.when(k % 7 != 0, F.lit(0.9) + k / F.lit(1000.0)).alias("glass_acc"),
        (k / F.lit(50.0)).alias("elapsed_sec"),
        F.when((F.col("event_type") == "error") & (k % 4 == 0), "timeout").alias("error"),
        F.col("ts").alias("mtime"), "event_id")


def boxed_units(spark: SparkSession, sf: str) -> DataFrame:
    """Detections per supplier document: one box per order line, many of them close together."""
    x, y = F.col("l_partkey") % 40 * 25, F.col("l_orderkey") % 30 * 25
    w, h = 60 + F.col("p_size"), 80 + F.col("p_size") % 7
    kind = part_kind()
    return lines_with_parts(spark, sf).select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"),
        F.col("l_orderkey").alias("region_no"), F.col("l_partkey").alias("item_no"), kind.alias("kind"),
        F.concat_ws("-", "l_linenumber", "l_orderkey", "l_partkey").alias("unit_id"),
        panels_of(kind, F.lit(30.0), F.lit(60.0)).alias("panels"), F.col("l_quantity").cast("int").alias("qty"),
        (0.5 + F.col("l_discount")).alias("confidence"),
        F.array(F.struct(F.col("l_linenumber").alias("page"), F.lit("plan").alias("region"),
                         box(x, y, w, h).alias("bbox"))).alias("evidence"))

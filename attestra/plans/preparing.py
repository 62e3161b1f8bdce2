"""Pages before they are searched: which steps prepare them, and reading them with failures as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advice
from ..rules import STEP_RULES
from ..sources import reading, staged
from .queries import registered

#: The usual rules switch three steps off; here all are on.
ALL_ON = STEP_RULES | {
    "stretch_contrast": STEP_RULES["stretch_contrast"] | {"below_text_contrast": 60.0},
    "resize": STEP_RULES["resize"] | {"below_text_height_px": 20.0},
    "adaptive_threshold": STEP_RULES["adaptive_threshold"] | {"below_text_contrast": 30.0},
}
#: Measurements of a page, made from an item: name and the expression, the same for Spark and DuckDB.
MEASURED = {
    "width": "CAST(1200 + 40 * l_quantity AS INT)",
    "height": "CAST(1600 + 60 * (l_partkey % 20) AS INT)",
    "bx0": "CASE WHEN l_linenumber < 7 THEN CAST(10 * (l_suppkey % 20) AS INT) END",
    "by0": "CAST(12 * (l_partkey % 25) AS INT)",
    "bx1": "CAST(1200 + 32 * l_quantity AS INT)",
    "by1": "CAST(1600 + 60 * (l_partkey % 20) - 90 * l_linenumber AS INT)",
    "paper_level": "CAST(150 + l_partkey % 106 AS DOUBLE)",
    "text_contrast": "CAST(l_suppkey % 90 AS DOUBLE)",
    "ink_share": "CAST(l_discount AS DOUBLE)",
    "text_height": "CASE WHEN l_quantity < 50 THEN CAST(6 + 3 * l_quantity AS DOUBLE) END",
    "small_height": "CASE WHEN l_quantity < 50 THEN CAST(3 + 2 * l_quantity AS DOUBLE) END",
    "tilt": "CAST(l_partkey % 41 - 20 AS DOUBLE) / 4",
    "tilt_gain": "CAST(1 + l_tax AS DOUBLE)",
    "tilt_at_limit": "l_returnflag = 'R'",
    "background_spread": "CAST(l_partkey % 70 AS DOUBLE)",
    "noise": "CAST(l_quantity AS DOUBLE) / 4",
    "sharpness": "CAST(l_suppkey % 130 AS DOUBLE)",
}
_ROWS = "m AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{e} AS {n}" for n, e in MEASURED.items()) + " FROM lineitem)"
_ODD = "CAST(greatest(15, round_even({0}, 0)) AS INT) + CASE WHEN CAST(greatest(15, round_even({0}, 0)) AS INT) % 2 = 0 THEN 1 ELSE 0 END"
#: An amount of sharpening to two digits: half to even, by its shortest decimal print.
_AMOUNT = "CAST(CAST(0.3::DOUBLE + (1.0::DOUBLE - sharpness / 100.0::DOUBLE) * (1.2::DOUBLE - 0.3::DOUBLE) AS VARCHAR) AS DECIMAL(20,17)) * 100"
_EVEN = f"CAST(floor({_AMOUNT}) + CASE WHEN {_AMOUNT} - floor({_AMOUNT}) > 0.5 OR {_AMOUNT} - floor({_AMOUNT}) = 0.5 AND CAST(floor({_AMOUNT}) AS INT) % 2 = 1 THEN 1 ELSE 0 END AS DOUBLE) / 100"
_SHRINK = "least(1.0::DOUBLE, 2000.0::DOUBLE / greatest({0}, {1}))"


def _list(**when: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n.replace('__', ': ').replace('_x_', ' ')}' END" for n, c in when.items()) + ")"


@registered(f"""WITH {_ROWS}, a AS (SELECT *, greatest(10.0::DOUBLE, 2.0::DOUBLE * coalesce(text_height, 0)) AS mg FROM m),
b AS (SELECT *, greatest(0, CAST(trunc(bx0 - mg) AS INT)) AS x0, greatest(0, CAST(trunc(by0 - mg) AS INT)) AS y0, least(width, CAST(trunc(bx1 + mg) AS INT)) AS x1, least(height, CAST(trunc(by1 + mg) AS INT)) AS y1 FROM a),
c AS (SELECT *, bx0 IS NOT NULL AND 1.0::DOUBLE - CAST((x1 - x0) * (y1 - y0) AS DOUBLE) / (CAST(width AS DOUBLE) * height) >= 0.1::DOUBLE AS bare, {_SHRINK.format('x1 - x0', 'y1 - y0')} - {_SHRINK.format('width', 'height')} >= 0.1::DOUBLE AS gain FROM b),
d AS (SELECT *, bare AND gain AS crop, CASE WHEN bare AND gain THEN greatest(x1 - x0, y1 - y0) ELSE greatest(width, height) END AS side, background_spread > 35 AND paper_level < 220 AS flat FROM c),
e AS (SELECT *, CASE WHEN flat THEN least(255.0::DOUBLE, text_contrast * 255.0::DOUBLE / paper_level) ELSE text_contrast END AS ct, CASE WHEN flat THEN 255.0::DOUBLE ELSE paper_level END AS pp, abs(tilt) >= 1 AS tilted, tilt_gain >= 1.05::DOUBLE AS clear, small_height * least(1.0::DOUBLE, 2000.0::DOUBLE / side) AS seen, 32.0::DOUBLE / small_height AS fit FROM d),
f AS (SELECT *, ct > 0 AND ct < 60 AND ink_share > 0 AS stretched, coalesce(seen > 0 AND seen < 20, false) AS low, coalesce(seen > 90, false) AS high, least(3.0::DOUBLE, fit) AS wanted, least(3.0::DOUBLE, fit, 2000.0::DOUBLE / side) AS up, text_contrast < 30 AS faint, sharpness < 100 AS soft FROM e),
g AS (SELECT *, low AND up < 1.05::DOUBLE AS stuck, low AND up >= 1.05::DOUBLE AND up < wanted - 0.05::DOUBLE AS held, CASE WHEN low AND up >= 1.05::DOUBLE THEN up WHEN high AND NOT low THEN greatest(0.4::DOUBLE, fit) ELSE 1.0::DOUBLE END AS factor FROM f),
h AS (SELECT *, abs(factor - 1) >= 0.05::DOUBLE AS sized, NOT flat AND NOT stretched AND pp > 0 AND pp < 190 AS dark, tilted AND NOT tilt_at_limit AND clear AS turned FROM g)
SELECT l_orderkey, l_linenumber, {_list(crop='crop', denoise='noise > 5', rotate='turned', flatten_light='flat', stretch_contrast='stretched', brighten='dark', resize='sized', sharpen='soft AND NOT faint', adaptive_threshold='faint')} AS plan,
{_list(crop__gains_x_too_x_little='bare AND NOT gain', rotate__tilt_x_at_x_the_x_limit_x_of_x_the_x_search='tilted AND tilt_at_limit', rotate__gains_x_too_x_little='tilted AND NOT tilt_at_limit AND NOT clear', flatten_light__paper_x_is_x_white='background_spread > 35 AND NOT flat', stretch_contrast__ink_x_and_x_paper_x_do_x_not_x_differ='ct <= 0')} || '|' ||
concat_ws(',', CASE WHEN small_height IS NULL THEN 'resize: height of characters unknown' END, CASE WHEN stuck THEN 'resize: page is at the reader''s limit' END, CASE WHEN held THEN 'resize: held by the reader''s limit' END, CASE WHEN soft AND faint THEN 'sharpen: page is thresholded' END) AS notes,
CASE WHEN crop THEN x0 || ' ' || y0 || ' ' || x1 || ' ' || y1 END AS cut, CASE WHEN noise > 5 THEN round_even(least(20.0::DOUBLE, noise * 1.5::DOUBLE), 1) END AS strength, CASE WHEN turned THEN tilt END AS angle,
CAST(CASE WHEN flat THEN {_ODD.format('CASE WHEN text_height IS NOT NULL THEN text_height * 3.0::DOUBLE ELSE least(width, height) / 20.0::DOUBLE END')} END AS DOUBLE) AS kernel_px,
CASE WHEN stretched THEN round_even(pp - ct, 1) END AS ink_level, CASE WHEN dark THEN round_even(greatest(0.3::DOUBLE, ln(235.0::DOUBLE / 255.0::DOUBLE) / ln(pp / 255.0::DOUBLE)), 3) END AS gamma, CASE WHEN sized THEN round_even(factor, 3) END AS scale,
CASE WHEN soft AND NOT faint THEN {_EVEN} END AS amount,
CAST(CASE WHEN faint THEN {_ODD.format('coalesce(text_height, least(width, height) / 40.0::DOUBLE) * CASE WHEN sized THEN factor ELSE 1.0::DOUBLE END * 2.5::DOUBLE')} END AS DOUBLE) AS block_px, CASE WHEN faint THEN round_even(greatest(5.0::DOUBLE, noise * 2.0::DOUBLE), 1) END AS threshold_offset FROM h""")
def page_advice(spark, sf_dir):
    """The steps that pages of every kind get, with their parameters, and what was weighed and left out."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pages = items.selectExpr("l_orderkey", "l_linenumber", *(f"{e} AS {n}" for n, e in MEASURED.items()))
    pages = pages.withColumn("content_box", F.when(F.col("bx0").isNotNull(), F.array("bx0", "by0", "bx1", "by1")))
    out = advice.advised(pages, ALL_ON)
    of = lambda step, name: advice.param(step, name)
    notes = lambda late: F.array_join(F.filter("notes", lambda n: F.exists(F.array(F.lit("resize"), F.lit("sharpen")), lambda k: F.startswith(n, k)) == late), ",")
    cut = F.concat_ws(" ", *[of("crop", k).cast("int").cast("string") for k in ("left", "top", "right", "bottom")])
    return out.select(
        "l_orderkey", "l_linenumber",
        F.array_join(F.transform("steps", lambda s: s["name"]), ",").alias("plan"),
        F.concat(notes(False), F.lit("|"), notes(True)).alias("notes"),
        F.nullif(cut, F.lit("")).alias("cut"),
        of("denoise", "strength").alias("strength"), of("rotate", "angle").alias("angle"), of("flatten_light", "kernel_px").alias("kernel_px"),
        of("stretch_contrast", "ink_level").alias("ink_level"), of("brighten", "gamma").alias("gamma"), of("resize", "scale").alias("scale"),
        of("sharpen", "amount").alias("amount"), of("adaptive_threshold", "block_px").alias("block_px"), of("adaptive_threshold", "offset").alias("threshold_offset"),
    )


class Paragraphs:
    """A reader of web pages: each paragraph is a page, its words lie in a line; those that are marked as ``broken`` cannot be read."""

    def __init__(self, broken: str | None):
        self.broken = broken

    def start(self) -> None:
        pass

    def pages(self, content: bytes) -> list[str]:
        return content.decode().split("</p>")

    def words(self, page: str) -> list[tuple[str, float, list[list[float]]]]:
        if self.broken and self.broken in page:
            raise ValueError("cannot be read")
        return [(w, 1.0, [[10.0 * i, 0.0], [10.0 * i + 8, 0.0], [10.0 * i + 8, 10.0], [10.0 * i, 10.0]]) for i, w in enumerate(page.split(" "))]


def _html(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.col("page_id").cast("string").alias("doc_id"), F.encode("html", "UTF-8").alias("content"))


def _shown(readings):
    return readings.withColumn("n_words", F.size("words").cast("long")).withColumn("digest", F.md5(F.array_join(F.transform("words", lambda w: w["text"]), " "))).drop("words")


PARTS = "p AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, string_split(html, '</p>') AS parts FROM pages), w AS (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS page FROM p), bad AS (SELECT *, contains(part, '###') AS failed FROM w)"


@registered(f"WITH {PARTS} SELECT doc_id, CAST(page AS INT) AS page, CASE WHEN failed THEN 'read: ValueError: cannot be read' END AS error, CASE WHEN NOT failed THEN CAST(len(string_split(part, ' ')) AS BIGINT) END AS n_words, CASE WHEN NOT failed THEN md5(part) END AS digest FROM bad UNION ALL SELECT doc_id, 0, 'load: ValueError: no content', NULL, NULL FROM p WHERE parts IS NULL")
def page_readings(spark, sf_dir):
    """Web pages read by paragraphs; some paragraphs fail, each in its own row."""
    return _shown(reading.read_pages(_html(spark, sf_dir), Paragraphs("###")))


@registered(f"WITH {PARTS} SELECT doc_id, CAST(page AS INT) AS page, CAST(NULL AS VARCHAR) AS error, failed AS again, CAST(len(string_split(part, ' ')) AS BIGINT) AS n_words, md5(part) AS digest FROM bad UNION ALL SELECT doc_id, 0, 'load: ValueError: no content', true, NULL, NULL FROM p WHERE parts IS NULL")
def resumed_readings(spark, sf_dir):
    """The same with a second run, which reads only the paragraphs that failed in the first."""
    files = _html(spark, sf_dir)
    first = staged.staged(reading.read_pages(files, Paragraphs("###")))
    return _shown(reading.resumed(files, first, Paragraphs(None)))

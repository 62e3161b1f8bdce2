"""Plans of preparing steps, reading page by page, and scans of some months."""

from __future__ import annotations

import json

import pytest

from attestra import rules
from attestra.operators import advice, geometry
from attestra.plans import preparing
from attestra.sources import reading, store

GOOD = {"width": 1000, "height": 1600, "content_box": [0, 0, 1000, 1600], "paper_level": 250.0, "text_contrast": 150.0, "ink_share": 0.05, "text_height": 30.0, "small_height": 24.0, "tilt": 0.2, "tilt_gain": 1.0, "tilt_at_limit": False, "background_spread": 10.0, "noise": 1.0, "sharpness": 500.0}
CASES = [
    ({}, {}, []),
    ({"width": 1000, "height": 4000, "content_box": [100, 100, 900, 1900]}, {"crop": {"left": 40, "top": 40, "right": 960, "bottom": 1960}}, []),
    ({"content_box": [100, 100, 900, 1100]}, {}, ["crop: gains too little"]),
    ({"noise": 6.0}, {"denoise": {"strength": 9.0}}, []),
    ({"noise": 50.0}, {"denoise": {"strength": 20.0}}, []),
    ({"tilt": -2.5, "tilt_gain": 1.2}, {"rotate": {"angle": -2.5}}, []),
    ({"tilt": -2.5, "tilt_gain": 1.01}, {}, ["rotate: gains too little"]),
    ({"tilt": 10.0, "tilt_gain": 1.5, "tilt_at_limit": True}, {}, ["rotate: tilt at the limit of the search"]),
    ({"background_spread": 50.0, "paper_level": 180.0}, {"flatten_light": {"kernel_px": 91}}, []),
    ({"background_spread": 50.0}, {}, ["flatten_light: paper is white"]),
    ({"background_spread": 50.0, "paper_level": 180.0, "text_height": None}, {"flatten_light": {"kernel_px": 51}}, []),
    ({"paper_level": 128.0}, {"brighten": {"gamma": 0.3}}, []),
    ({"paper_level": 189.0}, {"brighten": {"gamma": 0.3}}, []),
    ({"text_contrast": 0.0}, {}, ["stretch_contrast: ink and paper do not differ"]),
    ({"small_height": 120.0}, {"resize": {"scale": 0.4}}, []),
    ({"small_height": None}, {}, ["resize: height of characters unknown"]),
    ({"sharpness": 50.0}, {"sharpen": {"amount": 0.75, "radius_px": 1.2}}, []),
    (dict.fromkeys(GOOD), {}, ["resize: height of characters unknown"]),
]


def plans(spark, pages, given=rules.STEP_RULES, **options):
    df = spark.createDataFrame([tuple({**GOOD, **p}[k] for k in GOOD) + (i,) for i, p in enumerate(pages)], advice.MEASURES + ", no int")
    return [({s.name: s.params for s in r.steps}, r.notes, r.steps) for r in advice.advised(df, given, **options).orderBy("no").collect()]


def test_steps_and_notes(spark):
    for (page, steps, notes), got in zip(CASES, plans(spark, [c[0] for c in CASES]), strict=True):
        assert got[:2] == (steps, notes), page


def test_later_steps_see_earlier_ones(spark):
    on = preparing.ALL_ON
    pages = [
        {"paper_level": 100.0, "background_spread": 50.0, "text_contrast": 40.0},  # flattening brings the contrast to 102, so nothing is stretched or brightened
        {"paper_level": 180.0, "text_contrast": 40.0},  # stretched, so not brightened
        {"width": 1000, "height": 4000, "content_box": [0, 0, 1000, 1400], "small_height": 8.0},  # cut first, so enlarged as far as the cut page allows
        {"width": 4000, "height": 2000, "content_box": None, "small_height": 12.0},  # enlarged in vain
        {"text_contrast": 20.0, "sharpness": 10.0},
    ]
    got = plans(spark, pages, on)
    assert got[0][0] == {"flatten_light": {"kernel_px": 91}}
    assert got[1][0] == {"stretch_contrast": {"ink_level": 140.0, "paper_level": 180.0, "target_ink": 20.0, "target_paper": 235.0}}
    assert [s.name for s in got[2][2]] == ["crop", "resize"] and got[2][0]["resize"] == {"scale": round(2000 / 1460, 3)} and got[2][1] == ["resize: held by the reader's limit"]
    assert got[2][2][0].reason == "64% of the page is empty; read at x1.00 instead of x0.50"
    assert got[3][:2] == ({}, ["resize: page is at the reader's limit"])
    assert got[4][0].keys() == {"stretch_contrast", "adaptive_threshold"} and got[4][1] == ["sharpen: page is thresholded"]
    assert "resize" in plans(spark, [pages[3]], on, max_side=float("inf"))[0][0]


def test_plans_are_page_transforms(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([tuple({**GOOD, "width": 1000, "height": 4000, "content_box": [100, 100, 900, 1900], "small_height": 120.0}[k] for k in GOOD)], advice.MEASURES)
    m = geometry.page_transform(F.col("steps"), F.col("width"), F.col("height"))
    assert advice.advised(df).select(m.alias("m")).first().m == [0.4, 0.0, -16.0, 0.0, 0.4, -16.0]


def test_step_rule_files():
    assert rules.load_step_rules(json.dumps(rules.STEP_RULES)) == rules.STEP_RULES
    with pytest.raises(ValueError, match="'crop.min_trim_share'.*'resize.size_basis'"):
        rules.load_step_rules(json.dumps(rules.STEP_RULES | {"crop": {**rules.STEP_RULES["crop"], "min_trim_share": True}, "resize": {**rules.STEP_RULES["resize"], "size_basis": "large"}}))


def lines_reader(broken: str, log: str, engine: bool = True):
    """A reader whose class goes to the tasks by value, as they cannot import this file."""

    class Lines:
        """Pages by form feed, words by blanks; counts what it reads in a file."""

        ready = False

        def start(self):
            if not engine:
                raise RuntimeError("no engine")
            self.ready = True

        def pages(self, content):
            for p in content.decode().split("\f") if content else ():
                if p == "torn":
                    raise OSError("torn")
                yield p

        def words(self, page):
            assert self.ready
            if page in broken.split():
                raise ValueError(page)
            with open(log, "a") as f:
                f.write(page + "\n")
            return [(w, 0.5, [[0.0, 0.0]] * 4) for w in page.split()]

    return Lines()


def test_failures_are_rows_and_are_read_again(spark, tmp_path):
    files = spark.createDataFrame([("a", b"one two\fbad\fthree"), ("b", b"four\ftorn\fnever"), ("c", b""), ("d", None), ("e", b"five"), ("e2", b"\f")], "doc_id string, content binary")
    log = str(tmp_path / "log")
    first = reading.read_pages(files, lines_reader("bad", log))
    first.write.parquet(str(tmp_path / "first"))
    first = spark.read.parquet(str(tmp_path / "first"))
    got = {(r.doc_id, r.page): (None if r.words is None else [w.text for w in r.words], r.error) for r in first.collect()}
    assert got == {
        ("a", 1): (["one", "two"], None), ("a", 2): (None, "read: ValueError: bad"), ("a", 3): (["three"], None),
        ("b", 1): (["four"], None), ("b", 2): (None, "load: OSError: torn"), ("c", 0): (None, "load: no pages"), ("d", 0): (None, "load: ValueError: no content"),
        ("e", 1): (["five"], None), ("e2", 1): ([], None), ("e2", 2): ([], None),
    }
    words = reading.words_of(first)
    assert [(f.name, f.dataType) for f in words.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], store.WORDS).schema] and words.count() == 5
    open(log, "w").close()
    again = {(r.doc_id, r.page, r.again): r.error for r in reading.resumed(files, first, lines_reader("", log)).collect()}
    assert open(log).read() == "bad\n"  # nothing that was read is read again
    assert again.pop(("a", 2, True)) is None and again.pop(("b", 2, True)) == "load: OSError: torn"
    assert {k for k in again if k[2]} == {("c", 0, True), ("d", 0, True)} and len([k for k in again if not k[2]]) == 6
    assert reading.read_pages(files.limit(0), lines_reader("", log)).collect() == []


def test_a_reader_that_cannot_start_fails_the_task(spark):
    with pytest.raises(Exception, match="no engine"):
        reading.read_pages(spark.createDataFrame([("a", b"x")], "doc_id string, content binary"), lines_reader("", "", engine=False)).collect()


def test_readings_and_truth_as_json(spark, tmp_path):
    words = [{"text": "TOTAL", "box": [[0, 0], [1, 0], [1, 1], [0, 1]]}]
    (tmp_path / "r.json").write_text(json.dumps({"small": [], "large": [{"page": "p1", "words": words}, {"page": "p2", "words": []}]}))
    (tmp_path / "t.json").write_text(json.dumps({"pages": {"p1": {"amounts": ["1.00", "2"], "ids": ["A1"]}, "p2": {}}}))
    (tmp_path / "odd.json").write_text("no json")
    read = reading.read_variant(spark, str(tmp_path / "r.json"), "large")
    assert {r.page_id: [(w.text, w.box[2]) for w in r.words] for r in read.collect()} == {"p1": [("TOTAL", [1.0, 1.0])], "p2": []}
    assert reading.read_variant(spark, str(tmp_path / "r.json"), "none").count() == 0 == reading.read_variant(spark, str(tmp_path / "odd.json"), "large").count()
    truth = sorted(map(tuple, reading.read_truth(spark, str(tmp_path / "t.json")).collect()), key=repr)
    assert truth == sorted([("p1", "amount", "1.00"), ("p1", "amount", "2"), ("p1", "id", "A1"), ("p2", None, None)], key=repr)


def test_some_months_only(spark, tmp_path):
    for folder in ("09_2026/Ada_L", "09_2026/Bob", "10_2026/Ada_L", "11[1]/Ada_L", "month_year=12%2F26/name=Ada_L"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "claim_form_1.pdf").write_bytes(b"x")
        (tmp_path / folder / "claim_meta.json").write_text('{"status": "Verified"}')
    root = str(tmp_path)
    seen = lambda **k: sorted({tuple(p.split("/")[-3:-1]) for p in store.list_files(spark, root, **k).inputFiles()})
    assert seen(months=["09_2026"]) == [("09_2026", "Ada_L"), ("09_2026", "Bob")]  # what Spark lists at all
    assert seen(months=["09_2026"], names=["Bob"]) == [("09_2026", "Bob")]
    assert len(seen(names=["Ada_L"])) == 4 and len(seen(months=["11[1]"])) == 1 and len(seen(months=["12/26"])) == 1 and len(seen()) == 5
    got = store.scan(spark, root, months=["10_2026", "none"]).collect()
    assert [(r.month, r.name, r.status) for r in got] == [("10_2026", "Ada_L", "Verified")]
    assert store.scan(spark, root, months=["none"]).count() == 0 and store.scan(spark, root).count() == 5

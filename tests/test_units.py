import pytest

from tessella.operators.units import pixel_nm, positions_in_nm, read_value, unit_in_notes, unit_in_system

SOURCES = "source_id long, data_type string, modality string, coordinate_system string, normalize_coordinates_to_microns boolean, metadata string, notes string, extra string"
ROWS = "row_id long, source_id long, x_text string, y_text string, delivered_at timestamp_ntz, x_nm long"


def values(spark, texts):
    from pyspark.sql import functions as F

    v, u = read_value(F.col("t"))
    return [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(v, u).collect()]


def test_numbers(spark):
    got = values(spark, ["1001,9290", "11,938.870", "+5.5", " 8277.184 ", "1.5e+03", "7 nm", "7.5 μm", "3MM", "5 pixels", "n/a", "-", "", None, "inf", "5 parsecs", "1,2,3"])
    assert got[:9] == [(1001.929, None), (11938.87, None), (5.5, None), (8277.184, None), (1500.0, None), (7.0, "nm"), (7.5, "um"), (3.0, "mm"), (5.0, "px")]
    assert all(v is None for v, _ in got[9:])


def test_evidence(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [("pixel (0.2125 um/px)", "x and y as microns, y grows downward.", "{}"), ("stage mm", "Scale bar in the figure shows 500 micrometres.", '{"px_per_um": 4}'), ("see notes", "Preview image is 800 pixels wide. Encoder output, nanometres.", "not json"), (None, None, None), ("", "One pixel spans 0.4 micrometres.", None)],
        "cs string, notes string, meta string",
    )
    got = [tuple(r) for r in df.select(unit_in_system(F.col("cs")), unit_in_notes(F.col("notes")), pixel_nm(F.col("meta"), F.col("cs"), F.col("notes"))).collect()]
    assert got == [("px", "um", 212.5), ("mm", None, 250.0), (None, "nm", None), (None, None, None), (None, None, 400.0)]


def test_order_of_evidence(spark):
    s = [
        (1, "a", "m", "px", True, "{}", None, ""), (2, "a", "m", None, None, '{"pixel_size": 0.5}', None, ""), (3, "a", "m", "custom", False, None, "all positions in mm of the slide", ""),
        (4, "a", "m", "unknown", None, None, "nothing here", ""), (5, "a", "m", "pixel", None, None, None, ""),
    ]
    r = [(i, i, "2", "4 nm", None, 0) for i in range(1, 6)] + [(1, 1, "2", "4 nm", None, 0), (6, 99, "1", "1", None, 0), (7, 1, "x", "1", None, 0), (None, 1, "1", "1", None, 0), (8, 1, "1 nm", "2 nm", None, 0), (9, None, "1 nm", "2 nm", None, 0)]
    out = {x.row_id: x for x in positions_in_nm(spark.createDataFrame(r, ROWS), spark.createDataFrame(s, SOURCES)).collect()}
    assert {k: (v.x_nm, v.y_nm) for k, v in out.items()} == {1: (2000, 4), 2: (1000, 4), 3: (2_000_000, 4), 4: (None, 4), 5: (None, 4), 6: (None, None), 7: (None, None), 8: (1, 2), 9: (1, 2)}
    assert {k for k, v in out.items() if v.review} == {4, 5, 6} and not out[7].readable


def test_prediction(spark):
    """A source that names no unit is predicted from sources that do, with a high confidence."""
    s = [(i, "a", "m", ("mm", "nm")[i % 2], None, None, None, "") for i in range(80)] + [(100, "a", "m", "custom", None, None, None, "")]
    r = [(i * 10 + j, i, f"{(3.25 + j, 3_250_000 + j)[i % 2]}", "1", None, 0) for i in range(80) for j in range(3)] + [(9999, 100, "2.75", "1.5", None, 0)]
    x = positions_in_nm(spark.createDataFrame(r, ROWS), spark.createDataFrame(s, SOURCES)).filter("row_id = 9999").first()
    assert (x.unit_x, x.basis, x.x_nm) == ("mm", "predicted", 2_750_000) and x.confidence >= 0.9


def test_decided_against_the_notes(spark):
    """Magnitudes that overlap, notes that are silent, and a note that the ensemble contradicts."""
    import random

    rnd, unit = random.Random(1), {"mm": 1e-3, "um": 1.0, "px": 2.0}
    s, r = [], []

    def source(i, system, notes, truth, meta='{"um_per_px": 0.5}'):
        s.append((i, rnd.choice("ab"), "m", system, None, meta, notes, ""))
        r.extend((i * 100 + j, i, f"{rnd.uniform(500, 9000) * unit[truth]:.4f}", "1", None, 0) for j in range(30))

    for i in range(240):
        u = ("mm", "um", "px")[i % 3]
        source(i, {"mm": "stage mm", "um": "microns", "px": "pixel"}[u], None, u)
    for i, u in enumerate(("mm", "um", "px") * 20):
        source(1000 + i, "custom", None, u)
        source(2000 + i, "custom", f"all positions in {u} of the slide", u)
    source(3000, "custom", "all positions in um of the slide", "mm")
    got = positions_in_nm(spark.createDataFrame(r, ROWS), spark.createDataFrame(s, SOURCES)).collect()
    noted = [x for x in got if 2000 <= x.source_id < 3000]
    bad = {(x.source_id, x.unit_x, x.basis, x.predicted, x.confidence, x.review) for x in noted if x.unit_x != ("mm", "um", "px")[(x.source_id - 2000) % 3] or x.review}
    assert not bad
    assert sum(x.basis == "predicted" for x in noted) >= 0.8 * len(noted)
    silent = [x for x in got if 1000 <= x.source_id < 2000 and x.unit_x is not None]
    assert len(silent) >= 15 * 30 and sum(x.unit_x == ("mm", "um", "px")[(x.source_id - 1000) % 3] for x in silent) >= 0.9 * len(silent)
    assert all(x.review and x.basis == "none" for x in got if 1000 <= x.source_id < 2000 and x.unit_x is None)
    last = [x for x in got if x.source_id == 3000]
    assert {(x.unit_x, x.basis) for x in last} == {("um", "notes")} and (last[0].predicted == "um" or all(x.review for x in last) or last[0].confidence < 0.9)


def test_few_examples(spark):
    """One class alone is predicted with a confidence that grows with its examples; none gives none."""
    for n, want in ((3, (None, "none")), (30, ("mm", "predicted"))):
        s = [(i, "a", "m", "mm", None, None, None, "") for i in range(n)] + [(100, "a", "m", "custom", None, None, None, "")]
        r = [(i, i, "3.5", "1", None, 0) for i in [*range(n), 100]]
        x = positions_in_nm(spark.createDataFrame(r, ROWS), spark.createDataFrame(s, SOURCES)).filter("source_id = 100").first()
        assert (x.unit_x, x.basis) == want and x.predicted == "mm" and x.review == (n == 3)
    x = positions_in_nm(spark.createDataFrame(r[-1:], ROWS), spark.createDataFrame(s[-1:], SOURCES)).first()
    assert (x.unit_x, x.predicted, x.confidence, x.basis) == (None, None, None, "none")


@pytest.mark.parametrize("which", ["rows", "sources", "both"])
def test_empty(spark, which):
    r = spark.createDataFrame([(1, 1, "2", "3", None, 0)], ROWS)
    s = spark.createDataFrame([(1, "a", "m", "um", None, None, None, "")], SOURCES)
    out = positions_in_nm(r.limit(0) if which != "sources" else r, s.limit(0) if which != "rows" else s)
    assert out.count() == (1 if which == "sources" else 0)

"""Positions written in mixed units, converted to whole nanometres.

Evidence is read from the value's own text, a normalisation flag, the named coordinate
system and free-text notes.  A calibrated tree ensemble, trained on sources whose unit is
written, decides for sources that do not name one, from magnitude, data category and what
neighbouring fields say.  Confident decisions are converted.  A unit the notes state is the
exact check: it settles what the ensemble leaves open, and where the two differ it wins and the
rows are marked for review; where nothing is written, an uncertain decision goes to review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.identifiers import finite
from tessella.session import materialise

# Spellings of the units, and their size in nanometres.
UNITS = {
    "px": (("px", "pixel", "pixels"), None),
    "um": (("um", "µm", "μm", "micron", "microns", "micrometer", "micrometers", "micrometre", "micrometres"), 1e3),
    "mm": (("mm", "millimeter", "millimeters", "millimetre", "millimetres"), 1e6),
    "nm": (("nm", "nanometer", "nanometers", "nanometre", "nanometres"), 1.0),
    "cm": (("cm", "centimeter", "centimeters", "centimetre", "centimetres"), 1e7),
}
CLASSES = list(UNITS)
_WORD = {u: "(?:" + "|".join(sorted(w, key=len, reverse=True)) + ")" for u, (w, _) in UNITS.items()}
_ANY = "(?:" + "|".join(sorted((x for w, _ in UNITS.values() for x in w), key=len, reverse=True)) + ")"
_LENGTH = "(?:" + "|".join(sorted((x for u, (w, _) in UNITS.items() if u != "px" for x in w), key=len, reverse=True)) + ")"
_SUBJECT = r"(?:positions?|coordinates?|centroids?|distances?|locations?|x\s*(?:,|/|and|&)\s*y|encoder output)"
_NUMBER = r"([0-9]*[.,]?[0-9]+(?:e[+-]?[0-9]+)?)"


def _alone(pattern: str) -> str:
    return rf"(?<!\p{{L}}){pattern}(?!\p{{L}})"


def unit_of_word(word: Column) -> Column:
    """Unit code of a single unit word, else null."""
    w = F.regexp_replace(F.lower(F.btrim(word)), r"\.$", "")
    out = F.lit(None).cast("string")
    for unit, (words, _) in UNITS.items():
        out = F.when(w.isin(*words), unit).otherwise(out)
    return out


def unit_in_system(text: Column) -> Column:
    """Unit a coordinate system names; a pixel word wins over a length, which is then its size."""
    t = F.lower(text)
    out = F.lit(None).cast("string")
    for unit in reversed(CLASSES):
        out = F.when(t.rlike(_alone(_WORD[unit])), unit).otherwise(out)
    return out


def unit_in_notes(text: Column) -> Column:
    """Unit in which notes say the positions are; other lengths in the notes do not count."""
    t = F.lower(text)
    after = F.regexp_extract(t, rf"(?<!\p{{L}}){_SUBJECT}(?!\p{{L}})[^.;]{{0,60}}?(?<![0-9] )(?<![0-9\p{{L}}])({_ANY})(?!\p{{L}})", 1)
    before = F.regexp_extract(t, rf"(?<![0-9] )(?<![0-9\p{{L}}])({_ANY})\s+{_SUBJECT}(?!\p{{L}})", 1)
    return F.coalesce(unit_of_word(after), unit_of_word(before))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _in_nm(number: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for u, (_, size) in UNITS.items():
        if size:
            out = F.when(unit == u, number * F.lit(size)).otherwise(out)
    return out


def pixel_nm(metadata: Column, system: Column, notes: Column) -> Column:
    """Size of a pixel in nanometres from metadata (JSON), else the coordinate system, else notes."""
    js = lambda path: _number(F.get_json_object(metadata, path))
    size = rf"{_NUMBER}\s*({_LENGTH})(?!\p{{L}})"
    sized = lambda text, pattern: _in_nm(_number(F.regexp_extract(text, pattern, 1)), unit_of_word(F.regexp_extract(text, pattern, 2)))
    resolution, cs, nt = F.lower(F.get_json_object(metadata, "$.resolution")), F.lower(system), F.lower(notes)
    found = F.coalesce(
        js("$.pixel_size_nm"),
        *[js(f"$.{p}{k}") * 1e3 for p in ("", "scale.") for k in ("um_per_px", "um_per_pixel", "pixel_size_um", "pixel_size")],
        *[1e3 / F.nullif(js(f"$.{p}px_per_um"), F.lit(0.0)) for p in ("", "scale.")],
        sized(resolution, size),
        sized(cs, size),
        sized(nt, size + r"\s*(?:per|/)\s*(?:px|pixel)"),
        sized(nt, rf"(?:px|pixel)s?\s+(?:spans?|edges?|size|width|pitch|is|are|measures?)?\s*(?:=|:|is|of)?\s*{size}"),
    )
    return F.when(finite(found) & (found > 0), found)


def read_value(text: Column) -> tuple[Column, Column]:
    """(number, unit code or null) of a written value; the number is null if it can't be read.

    A comma is a decimal sign unless a point follows it, in which case it groups thousands.
    Text after the number that is no unit makes the value unreadable.
    """
    t = F.btrim(F.regexp_replace(F.regexp_replace(text, "[\\u00a0\\u2007\\u2009\\u202f\\u3000\\t]", " "), "\\u2212", "-"))
    shape = r"^([+-]?(?:[0-9][0-9.,]*|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?)\s*([^0-9\s].*)?$"
    n, word = F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 2)
    n = F.when(n.rlike(r",.*\."), F.replace(n, F.lit(","), F.lit(""))).otherwise(F.replace(n, F.lit(","), F.lit(".")))
    unit = unit_of_word(word)
    return F.when((word == "") | unit.isNotNull(), n.try_cast("double")), unit


def source_evidence(sources: DataFrame) -> DataFrame:
    """What each source says about its unit: one row per source_id (the largest row of repeats)."""
    cols = ["coordinate_system", "normalize_coordinates_to_microns", "metadata", "notes", "data_type", "modality"]
    s = sources.filter("source_id is not null").groupBy("source_id").agg(F.max(F.struct(*cols)).alias("m")).select("source_id", "m.*")
    cs, notes = F.col("coordinate_system"), F.col("notes")
    return s.select(
        "source_id", "data_type", "modality",
        F.when(F.coalesce("normalize_coordinates_to_microns", F.lit(False)), "um")
        .when(cs.isNull(), "px").otherwise(unit_in_system(cs)).alias("named"),
        unit_in_notes(notes).alias("noted"),
        unit_in_system(cs).alias("system"),
        F.coalesce("normalize_coordinates_to_microns", F.lit(False)).cast("double").alias("flag"),
        pixel_nm(F.col("metadata"), cs, notes).alias("pixel_nm"),
        F.concat_ws(" ", cs, notes).alias("words"),
    )


def _features(examples: DataFrame) -> DataFrame:
    """Adds ``features``: magnitude (also as if in pixels), form of the numbers, flag, category, words and what is said of the unit."""
    from pyspark.ml.feature import HashingTF, VectorAssembler

    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("words", F.lit(""))), r"[^\p{L}]+", " "), " "), lambda t: (t != "") & ~t.rlike(f"^{_ANY}$"))
    kinds = F.array(F.concat(F.lit("type="), F.coalesce("data_type", F.lit(""))), F.concat(F.lit("mod="), F.coalesce("modality", F.lit(""))))
    e = examples.withColumn("tokens", F.concat(words, kinds))
    for u in CLASSES:
        e = e.withColumn(f"says_{u}", F.coalesce((F.col("says") == u).cast("double"), F.lit(0.0)))
    e = e.withColumn("sized", F.col("pixel_nm").isNotNull().cast("double")).withColumn("as_pixels", F.coalesce(F.col("magnitude") + F.log10("pixel_nm"), F.lit(-99.0)))
    e = HashingTF(inputCol="tokens", outputCol="bag", numFeatures=64, binary=True).transform(e)
    return VectorAssembler(inputCols=["magnitude", "as_pixels", "whole", "sized", "flag", *[f"says_{u}" for u in CLASSES], "bag"], outputCol="features").transform(e)


def _calibrated(p: Column, steps: list[tuple[float, float]], held: float) -> Column:
    """Value of the fitted step curve at ``p``, drawn towards ``p`` by one pseudo-observation."""
    out = F.lit(float(steps[0][1]))
    for bound, value in steps:
        out = F.when(p >= bound, float(value)).otherwise(out)
    return (out * held + p) / (held + 1)


def predict_units(examples: DataFrame, *, max_examples: int = 20_000, trees: int = 30, depth: int = 8) -> DataFrame:
    """Predicted unit and calibrated confidence of every example without a label: (source_id, predicted, confidence).

    ``examples`` has one row per source and written unit, ``label`` null where none is written,
    ``says`` the unit that neighbouring fields name.  The forest is fitted on at most
    ``max_examples`` labelled examples, picked by a hash of the source, each of them once as it
    is and once without words and with nothing said, so magnitude and category count too.  Every fourth source is
    held out to calibrate the probabilities by isotonic regression.  The fewer labelled examples
    n, the lower the confidence, which is multiplied by n / (n + 2).  With one class alone that
    class is predicted; without labelled examples nothing is.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    e = examples.withColumn("h", F.xxhash64("source_id", "label"))
    labelled = e.filter("label is not null").orderBy("h").limit(max_examples)
    labelled = labelled.unionByName(labelled.withColumn("says", F.lit(None).cast("string")).withColumn("words", F.lit("")))
    wanted = e.filter("label is null")
    index = F.element_at(F.create_map(*[F.lit(v) for i, u in enumerate(CLASSES) for v in (u, float(i))]), F.col("label"))
    f = materialise(_features(labelled.unionByName(wanted)).select("source_id", "label", "h", "features", index.alias("y")))
    labelled, wanted = f.filter("label is not null"), f.filter("label is null")
    held = F.pmod(F.col("h"), F.lit(4)) == 0
    seen = {r.y: (r.fit, r.held) for r in labelled.groupBy("y").agg(F.count_if(~held).alias("fit"), F.count_if(held).alias("held")).collect()}  # a row a class
    n = sum(a + b for a, b in seen.values()) / 2
    fit = {y for y, (a, _) in seen.items() if a}
    if len(fit) < 2:
        only = next(iter(seen), None) if len(seen) == 1 else None
        return wanted.select("source_id", F.lit(None if only is None else CLASSES[int(only)]).cast("string").alias("predicted"), F.lit(None if only is None else n / (n + 2)).cast("double").alias("confidence"))
    model = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=7).fit(labelled.filter(~held))
    top = lambda df: model.transform(df).withColumn("p", F.array_max(vector_to_array("probability")))
    steps, tried = [(0.0, 0.0)], sum(b for _, b in seen.values())
    if tried:
        curve = IsotonicRegression(featuresCol="p", labelCol="right", predictionCol="iso").fit(top(labelled.filter(held)).withColumn("right", (F.col("prediction") == F.col("y")).cast("double")))
        steps = list(zip(curve.boundaries.toArray(), curve.predictions.toArray(), strict=True))
    names = F.array(*[F.lit(u) for u in CLASSES])
    return top(wanted).select("source_id", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"), (_calibrated(F.col("p"), steps, tried / 2) * (n / (n + 2))).alias("confidence"))


def positions_in_nm(rows: DataFrame, sources: DataFrame, *, confident: float = 0.9) -> DataFrame:
    """Every delivered position once, in whole nanometres where its unit is settled.

    Columns: row_id, source_id, x_nm, y_nm (null if not settled or not readable), unit_x, unit_y,
    basis (text, named, notes, predicted, none: of x), predicted, confidence, readable, review.

    * Repeated rows of a row_id count once (the largest delivery); null row_ids are dropped.
    * A row of an unknown source, or in pixels of unknown size, is readable but not converted.
    * Where a source names no unit, the ensemble decides (basis predicted) if its confidence
      reaches ``confident`` and the notes do not state another unit.
    * Else the unit the notes state settles it (basis notes).
    * ``review`` marks readable rows that were not converted, and those of a confident decision
      against the notes.
    """
    vx, ux = read_value(F.col("x_text"))
    vy, uy = read_value(F.col("y_text"))
    r = (
        rows.filter("row_id is not null").groupBy("row_id").agg(F.max(F.struct("delivered_at", "source_id", "x_text", "y_text")).alias("m")).select("row_id", "m.*")
        .select("row_id", "source_id", vx.alias("vx"), ux.alias("ux"), vy.alias("vy"), uy.alias("uy"))
    )
    r = materialise(r)
    ev = materialise(source_evidence(sources))
    size = F.log10(F.abs("vx") + F.lit(1e-9))
    stats = r.filter(finite("vx") & (F.col("ux").isNull() | (F.col("ux") == F.col("uy")))).groupBy("source_id", F.col("ux").alias("text_unit")).agg(
        F.percentile_approx(size, 0.5, 1000).alias("magnitude"), F.avg((F.col("vx") == F.floor("vx")).cast("double")).alias("whole")
    )
    own = F.col("text_unit").isNull()  # values with a unit of their own say nothing of their source's
    examples = ev.join(stats, "source_id").withColumn("label", F.coalesce("text_unit", "named")).withColumn("says", F.when(own, F.coalesce("system", "noted"))).withColumn("flag", F.when(own, F.col("flag")).otherwise(0.0))
    guess = predict_units(examples)
    ev = ev.join(guess, "source_id", "left")
    j = r.join(ev.select("source_id", "named", "noted", "pixel_nm", "predicted", "confidence"), "source_id", "left")
    sure = F.when(F.col("confidence") >= confident, F.col("predicted"))
    against = sure.isNotNull() & (F.col("noted") != sure)
    decided = F.when(~F.coalesce(against, F.lit(False)), sure)
    rest = F.coalesce("named", decided, "noted")
    j = j.withColumn("unit_x", F.coalesce("ux", rest)).withColumn("unit_y", F.coalesce("uy", rest))
    nm = lambda v, u: F.round(F.when(u == "px", v * F.col("pixel_nm")).otherwise(_in_nm(v, u))).cast("long")
    readable = finite("vx") & finite("vy")
    j = j.withColumn("x_nm", F.when(readable, nm(F.col("vx"), F.col("unit_x")))).withColumn("y_nm", F.when(readable, nm(F.col("vy"), F.col("unit_y"))))
    basis = F.when(F.col("ux").isNotNull(), "text").when(F.col("named").isNotNull(), "named").when(decided.isNotNull(), "predicted").when(F.col("noted").isNotNull(), "notes").otherwise("none")
    return j.select(
        "row_id", "source_id", "x_nm", "y_nm", "unit_x", "unit_y", basis.alias("basis"),
        "predicted", F.when(basis.isin("text", "named"), 1.0).otherwise(F.col("confidence")).alias("confidence"),
        readable.alias("readable"), (readable & (F.col("x_nm").isNull() | F.col("y_nm").isNull() | (basis.isin("notes") & F.coalesce(against, F.lit(False))))).alias("review"),
    )

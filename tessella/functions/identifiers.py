"""Cleaning of cell ids, gene names and category labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Measurements of a whole cell that ride along with genes.
PSEUDO_FEATURES = (
    "TRANSCRIPT_COUNTS",
    "TOTAL_COUNTS",
    "CELL_AREA",
    "NUCLEUS_AREA",
    "CONTROL_PROBE_COUNTS",
    "CONTROL_CODEWORD_COUNTS",
    "UNASSIGNED_CODEWORD_COUNTS",
)

# Names of control probes begin with one of these.
CONTROL_PREFIXES = (
    "UNASSIGNEDCODEWORD",
    "NEGCONTROLCODEWORD",
    "NEGCONTROLPROBE",
    "DEPRECATEDCODEWORD",
    "GENOMICCONTROL",
    "BLANK",
    "ANTISENSE",
    "NEGPROBE",
    "NEGCONTROL",
)

CONTROL_PATTERN = "^(" + "|".join(CONTROL_PREFIXES) + ")($|[-_.0-9])"


def clean_id(col: Column | str) -> Column:
    """Without blanks and double quotes around; an empty result is null."""
    return F.nullif(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(' "\t\r\n')), F.lit(""))


def gene_name(col: Column | str) -> Column:
    """Upper case, without the prefixes ``gene_`` and ``marker_``."""
    name = F.upper(F.col(col) if isinstance(col, str) else col)
    for prefix in ("GENE_", "MARKER_"):
        name = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name)
    return name


def is_control(name: Column) -> Column:
    """Control probe: a known prefix, then the end, a separator or a digit. ``name`` is upper case."""
    return name.rlike(CONTROL_PATTERN)


def is_expression(name: Column) -> Column:
    """Neither a whole-cell measurement nor a control probe."""
    return ~name.isin(*PSEUDO_FEATURES) & ~is_control(name)


NO_EXPRESSION = "^(?i)(?:gene_)?(?:marker_)?(?:(?:" + "|".join(PSEUDO_FEATURES) + ")$|(?:" + "|".join(CONTROL_PREFIXES) + ")(?:$|[-_.0-9]))"


def raw_is_expression(col: Column | str) -> Column:
    """``is_expression`` of a name as delivered, by one pattern, so a filter need not make the name first."""
    return ~(F.col(col) if isinstance(col, str) else col).rlike(NO_EXPRESSION)


def finite(col: Column | str) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


# Cell types that say nothing.
PLACEHOLDER_TYPES = ("", "unknown", "unannotatedcell")


def type_key(col: Column | str) -> Column:
    """Key under which spellings of a cell type agree; null for a placeholder.

    Only lower-cased letters, digits and ``+`` count.
    """
    c = F.col(col) if isinstance(col, str) else col
    key = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}+]", "")
    return F.when(key.isin(*PLACEHOLDER_TYPES), None).otherwise(key)

"""Canonical spellings of keys, ids and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blanks at the ends of an id.
_BLANKS = r"^[\s ]+|[\s ]+$"


def trimmed(c: Column) -> Column:
    """Without blanks, tabs and line ends at both ends; NULL where nothing is left."""
    out = F.regexp_replace(c, _BLANKS, "")
    return F.when(out != "", out)


def upper_id(c: Column) -> Column:
    """Ids and symbols: trimmed, upper case."""
    return F.upper(trimmed(c))


def lower_label(c: Column) -> Column:
    """Lineages and strata: trimmed, lower case."""
    return F.lower(trimmed(c))


def gene_id(c: Column) -> Column:
    """Gene ids: trimmed, upper case, without the version suffix of an Ensembl id."""
    return F.regexp_replace(upper_id(c), r"^(ENSG\d+)\.\d+$", "$1")


def ensembl_id(c: Column) -> Column:
    """The bare Ensembl gene id, NULL for anything that is none."""
    out = F.regexp_extract(upper_id(c), r"^(ENSG\d+)(\.\d+)?$", 1)
    return F.when(out != "", out)


def nan_to_null(c: Column) -> Column:
    """NaN means missing everywhere in the engine."""
    return F.when(~F.isnan(c), c)

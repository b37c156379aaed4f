"""Deterministic ids: SHA-256 over parts joined by a bar; a null part is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sid(*parts: Column | str) -> Column:
    """The id of a row; concat_ws alone would drop nulls, and two keys would fall together."""
    columns = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *columns), 256)

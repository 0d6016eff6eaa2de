"""Order of version strings: by numbers, a release after its prereleases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VERSION = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?$"


def version_key(version: Column) -> Column:
    """struct<major, minor, patch, release, pre>, whose order is that of versions; null where the text is no version.

    Prereleases of one version are in the order of their letters. Numbers may
    have up to 18 digits.
    """
    number = lambda k: F.regexp_extract(version, _VERSION, k).try_cast("bigint").alias(("major", "minor", "patch")[k - 1])
    pre = F.regexp_extract(version, _VERSION, 4)
    key = F.struct(number(1), number(2), number(3), (pre == "").alias("release"), pre.alias("pre"))
    return F.when(version.rlike(_VERSION), key)

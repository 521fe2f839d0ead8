"""Column expressions for refs, hashes and the tables' odd spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REF_RE = r"^[a-z0-9-]+/[a-z0-9-]+/[a-z0-9-]+\z"


def norm_ref(c: Column) -> Column:
    """The form in which equal refs are equal: trimmed of blanks, lower case."""
    return F.lower(F.trim(c))


def is_ref(c: Column) -> Column:
    """Three slash-separated parts of a-z, 0-9 and hyphen, nothing after them, not even a line feed."""
    return c.rlike(REF_RE)


def norm_hash(c: Column) -> Column:
    """The 64 hex digits of a hash as 32 bytes; other spellings as the bytes of their trimmed lower-case text.

    Letter case and the prefix ``sha256:`` carry no meaning.
    """
    t = F.regexp_replace(F.lower(F.trim(c)), r"^sha256:\s*", "")
    return F.when(t.rlike(r"^[0-9a-f]{64}\z"), F.unhex(t)).otherwise(F.encode(t, "UTF-8"))

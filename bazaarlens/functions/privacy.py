"""Masking and hashing expressions for shareable extracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col


def mask_text(value: Column | str, visible: int = 4) -> Column:
    """Keep the first ``visible`` characters; text no longer than that is all stars."""
    v = col(value)
    n = F.length(v)
    return F.when(n <= visible, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(v, 1, visible), F.repeat(F.lit("*"), n - F.lit(visible)))
    )


def mask_email(value: Column | str) -> Column:
    """Mailbox masked after two characters, domain (after the last ``@``) kept."""
    v = col(value)
    domain = F.substring_index(v, "@", -1)
    local = F.left(v, F.length(v) - F.length(domain) - F.lit(1))
    return F.when(F.instr(v, "@") > 0, F.concat(mask_text(local, 2), F.lit("@"), domain)).otherwise(
        mask_text(v)
    )


def slug(value: Column | str) -> Column:
    """Lower-case text, blanks and underscores as single hyphens, the rest dropped."""
    text = F.lower(F.trim(col(value)))
    for pattern, repl in ((r"[\s_]+", "-"), (r"[^a-z0-9-]", ""), (r"-+", "-"), (r"^-|-$", "")):
        text = F.regexp_replace(text, pattern, repl)
    return text


def digest_bucket(value: Column | str, buckets: int | Column = 100) -> Column:
    """Stable bucket: the md5 of the text, as a 128-bit number, modulo ``buckets``.

    The digest is folded 32 bits at a time so that no step leaves BIGINT.
    """
    digest = F.md5(col(value).cast("string"))
    acc = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        acc = (acc * F.lit(4294967296) + word) % (buckets if isinstance(buckets, Column) else F.lit(buckets))
    return acc

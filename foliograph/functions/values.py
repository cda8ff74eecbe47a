"""Times, formats and keys as Columns. Times are parameters, never the clock, so results can be checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_key(*parts: Column) -> Column:
    """Digest of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def memory_key(source_language: Column, target_language: Column, policy: Column, text: Column) -> Column:
    return sha256_key(source_language, target_language, policy, text)


def policy_fingerprint(policy: Column, fields: list[str]) -> Column:
    """Digest of a policy's fields as JSON in the fields' alphabetical order."""
    return F.sha2(F.to_json(F.struct(*(policy[f].alias(f) for f in sorted(fields)))), 256)


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end, not below 0; 0 if it never started. By calendar fields, so that times with and
    without zone count alike."""
    of_day = lambda t: (F.hour(t) * 3600 + F.minute(t) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    micros = F.date_diff(end, start).cast("long") * 86_400_000_000 + of_day(end) - of_day(start)
    return F.coalesce(F.greatest(F.lit(0).cast("long"), F.floor(micros / 1000)), F.lit(0).cast("long"))


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def archive_name(job: Column, at: Column) -> Column:
    return F.concat(F.lit("legacy/"), job, F.lit("-"), stamp(at), F.lit(".pdf"))


def shown_minute(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1048576.0))


def human_ms(ms: Column) -> Column:
    return (
        F.when(ms < 1000, F.format_string("%d ms", ms.cast("long")))
        .when(ms < 60_000, F.format_string("%.2f s", ms / 1000.0))
        .otherwise(F.format_string("%d min %d s", F.floor(ms / 60_000), F.floor(ms % 60_000 / 1000)))
    )


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code, or the code itself."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(pairs, code), code)

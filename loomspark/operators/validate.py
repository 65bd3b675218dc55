"""Validation: a reason for each rejected row, as Columns; rates by a token bucket in log time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.schema import SEVERITIES


class SchemaValidator:
    """Rejects an empty message, an empty source or a severity that isn't allowed, asked in this order."""

    name = "schema"

    def __init__(self, require_message: bool = True, require_source: bool = False, allowed_severities: Sequence[str] | None = None):
        self.require_message, self.require_source, self.allowed = require_message, require_source, allowed_severities

    def reason(self) -> Column:
        out = F.lit(None).cast("string")
        if self.allowed is not None:
            severity = F.coalesce("severity", F.lit("INFO"))
            out = F.when(~severity.isin(list(self.allowed)), F.concat(F.lit("severity "), severity, F.lit(" not in allowlist")))
        if self.require_source:
            out = F.when(F.coalesce("source", F.lit("")) == "", F.lit("missing source")).otherwise(out)
        if self.require_message:
            out = F.when(F.coalesce("message", F.lit("")) == "", F.lit("missing message")).otherwise(out)
        return out


class SizeValidator:
    """Rejects messages of more UTF-8 bytes than allowed."""

    name = "size"

    def __init__(self, max_message_bytes: int = 65_536):
        if max_message_bytes <= 0:
            raise ValueError("max_message_bytes must be > 0")
        self.most = max_message_bytes

    def reason(self) -> Column:
        n = F.octet_length("message")
        return F.when(n > self.most, F.concat(F.lit("message of "), n.cast("string"), F.lit(f" bytes exceeds {self.most}")))


class RateLimitValidator:
    """A token bucket for each source, on the rows' own time: a row is accepted if its bucket holds a token.

    A bucket starts full and refills with time, up to its capacity. Time that goes back refills nothing.
    """

    name = "rate_limit"

    def __init__(self, capacity: int = 1000, refill_per_sec: float = 1000.0):
        if capacity <= 0:
            raise ValueError("capacity must be > 0")
        if refill_per_sec <= 0:
            raise ValueError("refill_per_sec must be > 0")
        self.capacity, self.refill = float(capacity), float(refill_per_sec)

    def apply(self, df: DataFrame, order: Sequence[str], time: str = "timestamp", reason: str = "reject_reason") -> DataFrame:
        """df with the reason; rows that have one already take no token. order: the columns of arrival.

        A bucket is one after another by nature; a source is one sorted run through a task, which holds a single bucket
        and never the source's rows.
        """
        capacity, refill = self.capacity, self.refill
        schema = df.withColumn(reason, F.col(reason) if reason in df.columns else F.lit(None).cast("string")).schema
        df = df.withColumn(reason, F.col(reason) if reason in df.columns else F.lit(None).cast("string"))
        df = df.withColumn("_key", F.when(F.coalesce("source", F.lit("")) == "", F.lit("<unknown>")).otherwise(F.col("source")))
        df = df.withColumn("_now", F.unix_micros(F.col(time).cast("timestamp")) / 1e6)

        def run(batches: Iterator) -> Iterator:
            key, tokens, last = None, 0.0, None
            for pdf in batches:
                reasons = pdf[reason].tolist()
                for i, (k, now, why) in enumerate(zip(pdf["_key"].tolist(), pdf["_now"].tolist(), reasons, strict=True)):
                    if why is not None:
                        continue
                    now = last if now != now and k == key else now
                    if k != key:
                        key, tokens, last = k, capacity, now
                    if now is not None and now == now:
                        if last is not None and last == last:
                            tokens = min(capacity, tokens + max(0.0, now - last) * refill)
                        last = now
                    if tokens >= 1.0:
                        tokens -= 1.0
                    else:
                        reasons[i] = f"rate limit exceeded for {k}"
                yield pdf.drop(columns=["_key", "_now"]).assign(**{reason: reasons})

        ordered = df.repartition("_key").sortWithinPartitions("_key", *order)
        return ordered.mapInPandas(run, schema)


def chain(df: DataFrame, validators: Sequence, order: Sequence[str] = (), reason: str = "reject_reason", known: Column | None = None) -> DataFrame:
    """df with the reason of the first validator that rejects a row, null if none does; known: a reason from before.

    Later validators aren't asked about a row that is rejected; so it takes no token of a rate limit either.
    """
    if not validators:
        raise ValueError("a validation chain needs at least one validator")
    df = df.withColumn(reason, F.lit(None).cast("string") if known is None else known)
    for v in validators:
        df = v.apply(df, order, reason=reason) if isinstance(v, RateLimitValidator) else df.withColumn(reason, F.coalesce(reason, v.reason()))
    return df


def chain_name(validators: Sequence) -> str:
    return "validate:" + ",".join(v.name for v in validators)


def route(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and those for quarantine with their reason."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def build(kind: str, **options):
    """A validator of a configured kind; options of other kinds are ignored, as in an open configuration."""
    from loomspark.errors import ConfigurationError

    known = {"schema": (SchemaValidator, ("require_message", "require_source", "allowed_severities")), "size": (SizeValidator, ("max_message_bytes",)), "rate_limit": (RateLimitValidator, ("capacity", "refill_per_sec"))}
    if kind not in known:
        raise ConfigurationError(f"unknown validator kind: {kind!r} (registered: {sorted(known)})")
    cls, names = known[kind]
    options = {k: v for k, v in options.items() if k in names}
    if options.get("allowed_severities") is not None and not set(options["allowed_severities"]) <= set(SEVERITIES):
        raise ConfigurationError(f"unknown severity in {options['allowed_severities']}")
    try:
        return cls(**options)
    except ValueError as e:
        raise ConfigurationError(str(e)) from e

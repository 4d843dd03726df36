"""Latency, throughput, cache and cost metrics of one generation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def per_second(count: Column, ns: Column) -> Column:
    """Null unless both are positive."""
    return F.when((count > 0) & (ns > 0), count.cast("double") / (ns / F.lit(1e9)))


def ms_each(count: Column, ns: Column) -> Column:
    return F.when((count > 0) & (ns > 0), (ns / F.lit(1e6)) / count)


def uncached(count: Column, cached: Column) -> Column:
    """count - cached; the count where nothing is known of the cache; null where the two contradict."""
    return F.when(cached.isNull(), count).when((cached >= 0) & (cached <= count), count - cached)


def cache_ratio(count: Column, cached: Column) -> Column:
    return (
        F.when(cached.isNull() & count.isNotNull(), 0.0)
        .when((cached < 0) | (cached > count), None)
        .when(count == 0, 0.0)
        .otherwise(cached / F.when(count != 0, count))
    )


def cache_state(count: Column, cached: Column) -> Column:
    return (
        F.when(count.isNull() | (cached < 0) | (cached > count), "UNKNOWN")
        .when(count == 0, "UNCACHED")
        .when(cached.isNull(), "UNCACHED")
        .when(cached == 0, "UNCACHED")
        .when(cached == count, "FULLY_CACHED")
        .otherwise("PARTIAL")
    )


def span_ms(start_ns: Column, end_ns: Column) -> Column:
    return (end_ns - start_ns) / F.lit(1e6)


def reloaded(load_ms: Column, limit: float = 1000.0) -> Column:
    return F.coalesce(load_ms > limit, F.lit(False))


def token_bucket(count: Column) -> Column:
    """1-4, 5-32, 33-128, 129+; null has none."""
    return F.when(count <= 4, "1-4").when(count <= 32, "5-32").when(count <= 128, "33-128").when(count > 128, "129+")


def call_cost(given: Column, tokens: Column, per_thousand: Column) -> Column:
    """The provider's cost if finite and not negative, else tokens at a price, else null."""
    fine = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")), x)
    return F.coalesce(fine(given), fine(tokens / 1000 * per_thousand))


def residency(in_gpu: Column, size: Column) -> Column:
    return in_gpu / F.when(size > 0, size)


def residency_verdict(in_gpu: Column, size: Column, digest_ok: Column) -> Column:
    """Fails closed: what can't be measured is not eligible."""
    return (
        F.when(~F.coalesce(digest_ok, F.lit(False)), "INELIGIBLE_DIGEST")
        .when(in_gpu.isNull() | size.isNull() | (size <= 0), "INELIGIBLE_UNMEASURABLE")
        .when(in_gpu == size, "ELIGIBLE_GPU")
        .otherwise("INELIGIBLE_PARTIAL")
    )


def overhead_ms(client_ms: Column, server_ns: Column) -> Column:
    """What a client waited beyond the server's own time; may be negative."""
    return client_ms - server_ns / F.lit(1e6)


def canary(count: Column, least: int = 128) -> Column:
    """PASS if a canary gave at least so many tokens; what was not counted fails."""
    return F.when(F.coalesce(count >= least, F.lit(False)), "PASS").otherwise("FAIL")


def reclaimed(before: Column, after: Column, slack: int = 1 << 30) -> Column:
    """Whether free space is back to what it was, within the slack."""
    return after >= before - F.lit(slack)

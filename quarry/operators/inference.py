"""Batch model calls behind the keyed cache (INF-1..INF-5, FLT-6).

A *provider* is a plain Python callable ``list[str] -> list[result]``; a text
that fails has a :class:`TokenLimitError`, :class:`RateLimitError` or other
exception in its place (or the provider raises, and the batch is split).  It
runs inside ``mapInPandas`` over Arrow batches of **cache misses only**, so
Spark partitions the calls and a retry of a lost task re-calls only that
task's misses.  Rows over the size limits are routed with a status and never
sent.  Only ``status = 'ok'`` rows enter the cache.

The shipped provider is a deterministic hashing embedder (no network).
"""

from __future__ import annotations

import hashlib
import json

try:  # faster token hashing when available; md5 otherwise
    import xxhash
except ImportError:  # pragma: no cover
    xxhash = None
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import strip_ws
from quarry.operators.cache import cache_get, cache_misses, cache_put

# Size limits (characters) and the cache-prompt separator.
PROMPT_LIMIT = 96_000
EMBED_LIMIT = 5_000
SYSTEM_PROMPT_SEP = "____"
DEFAULT_DIM = 1024


class TokenLimitError(Exception):
    pass


class RateLimitError(Exception):
    pass


def limit_status(kind: Column, n_chars: Column) -> Column:
    """'ok' or 'token_limit' by kind ('embed' / 'prompt') (FLT-6)."""
    lim = F.when(kind == "embed", F.lit(EMBED_LIMIT)).otherwise(F.lit(PROMPT_LIMIT))
    return F.when(n_chars <= lim, F.lit("ok")).otherwise(F.lit("token_limit"))


def cache_key(subsystem: str, *parts) -> Column:
    """Subsystem and natural key columns joined by ``_`` (INF-5)."""
    return F.concat_ws("_", F.lit(subsystem), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


# --------------------------------------------------------------------------- providers
_TOKEN = re.compile(r"\w+", re.UNICODE)


def hashing_embedder(dim: int = DEFAULT_DIM):
    """Deterministic bag-of-words embedder: hashed bucket and sign per token, L2 normalised."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim, dtype=np.float32)
            for tok in _TOKEN.findall((t or "").lower()):
                b = tok.encode()
                h = xxhash.xxh64_intdigest(b) if xxhash else int.from_bytes(hashlib.md5(b).digest()[:8], "little")
                v[h % dim] += 1.0 if (h >> 63) & 1 == 0 else -1.0
            n = float(np.linalg.norm(v))
            out.append((v / n if n > 0 else v).tolist())
        return out
    return embed


def echo_model(texts: list[str]) -> list[str]:
    """Stand-in text model: replies with a tagged block around the prompt tail."""
    return [f"<reason>\nlength {len(t or '')}\n</reason>" for t in texts]


def _answers(provider, texts: list[str]) -> list[tuple]:
    """``(value, status, error)`` of each text; one failing text costs no other its answer.

    A provider reports a text's failure by returning the exception in its place.
    One that raises instead is asked again by halves, down to the failing texts.
    """
    try:
        results = list(provider(texts))
        if len(results) != len(texts):
            raise ValueError(f"{len(results)} results for {len(texts)} texts")
    except Exception as e:  # noqa: BLE001 - any provider failure becomes a status
        if len(texts) == 1:
            results = [e]
        else:
            half = len(texts) // 2
            return _answers(provider, texts[:half]) + _answers(provider, texts[half:])
    return [_answer(r) for r in results]


def _answer(result) -> tuple:
    if isinstance(result, TokenLimitError):
        return None, "token_limit", str(result)
    if isinstance(result, RateLimitError):
        return None, "rate_limited", str(result)
    if isinstance(result, Exception):
        return None, "error", f"{type(result).__name__}: {result}"
    return json.dumps(result), "ok", None


#: Calls of a provider whose answers a task holds before it hands them on.
CALLS_AT_ONCE = 32


def _run_provider(provider, value_kind: str, batch_size: int):
    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), CALLS_AT_ONCE * batch_size):
                part = pdf.iloc[lo:lo + CALLS_AT_ONCE * batch_size]
                texts = part["prompt"].tolist()
                got = [x for i in range(0, len(texts), batch_size) for x in _answers(provider, texts[i:i + batch_size])]
                values, status, errors = zip(*got)
                yield pd.DataFrame({"key": part["key"].tolist(), "prompt": texts, "value": list(values), "status": list(status), "error": list(errors)})
    return run


RESULT_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("prompt", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])


def call_cached(requests: DataFrame, cache: DataFrame | None, provider, kind: str = "embed",
                batch_size: int = 16, max_attempts: int = 1, seq: Column | None = None,
                materialize: bool = True):
    """Answer ``requests(key, prompt)`` from the cache, calling ``provider`` on misses.

    Rows with a NULL key are answered and never cached.  New cache rows carry
    ``seq`` (default: one more than the cache's largest), so they replace older
    ones; of several prompts for one key in a batch the greatest prompt stays.

    Returns ``(answers, new_cache)``: answers hold ``key, prompt, value,
    status, error, cached``; the new cache is the upsert of the ok results.
    ``max_attempts`` re-sends rate-limited rows (INF-4).  With
    ``materialize`` the provider results are checkpointed to the shared
    folder, so the answers and the cache come from one set of calls (a model
    is not deterministic) and a lost executor does not re-bill the calls.
    """
    req = requests.select("key", "prompt").distinct()
    n_chars = F.length("prompt")
    if kind == "prompt":  # the separator between system text and prompt is not sent
        n_chars = n_chars - F.when(F.col("prompt").contains(SYSTEM_PROMPT_SEP), len(SYSTEM_PROMPT_SEP)).otherwise(0)
    lim = limit_status(F.lit(kind), n_chars)
    if cache is not None:
        hits = cache_get(req, cache).where("hit").select("key", "prompt", "value", F.lit("ok").alias("status"),
                                                         F.lit(None).cast("string").alias("error"),
                                                         F.lit(True).alias("cached"))
        miss = cache_misses(req, cache)
    else:
        hits = None
        miss = req
    over = miss.where(lim != "ok").select("key", "prompt", F.lit(None).cast("string").alias("value"),
                                          lim.alias("status"), F.lit("over size limit").alias("error"))
    from quarry.session import spread
    send = spread(miss.where(lim == "ok"))
    res = send.mapInPandas(_run_provider(provider, kind, batch_size), RESULT_SCHEMA)
    from quarry.session import cut_lineage
    for _ in range(max_attempts - 1):
        # each attempt is kept before it is split: no row is sent twice for one answer
        res = cut_lineage(res)
        again = res.where(F.col("status") == "rate_limited").select("key", "prompt")
        done = res.where(F.col("status") != "rate_limited")
        res = done.unionByName(again.mapInPandas(_run_provider(provider, kind, batch_size), RESULT_SCHEMA))
    fresh = res.unionByName(over).withColumn("cached", F.lit(False))
    if materialize:
        fresh = cut_lineage(fresh)
    answers = fresh if hits is None else hits.unionByName(fresh)
    if seq is None:
        top = cache.agg(F.max("seq")).first()[0] if cache is not None else None
        seq = F.lit(0 if top is None else top + 1).cast("long")
    ok = fresh.where((F.col("status") == "ok") & F.col("key").isNotNull()).select("key", "prompt", "value", seq.alias("seq"))
    new_cache = cache_put(cache, ok)
    return answers, new_cache


def embed_text(col) -> Column:
    """Text as sent to the embedder (stripped)."""
    return strip_ws(col)


def invoke_prompt(prompt: Column, system: Column | None = None, default_system: str = "") -> Column:
    """Cache prompt of a text call: system + ``____`` + prompt (INF-2)."""
    sys_msg = F.coalesce(system, F.lit(default_system)) if system is not None else F.lit(default_system)
    return F.concat(sys_msg, F.lit(SYSTEM_PROMPT_SEP), prompt)


def rule_failing_provider(texts: list[str]) -> list[str]:
    """Test provider with fixed failure rules by text length (INF-3).

    length % 5 == 0 -> rate limited; % 7 == 0 -> token limit; % 11 == 0 ->
    other error; otherwise the reply ``ok <length>``.
    """
    out = []
    for t in texts:
        n = len(t or "")
        out.append(RateLimitError(f"rate limited ({n})") if n % 5 == 0 else TokenLimitError(f"token limit ({n})") if n % 7 == 0
                   else ValueError(f"bad request ({n})") if n % 11 == 0 else f"ok {n}")
    return out

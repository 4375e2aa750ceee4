"""Batch completion through user-supplied callables, and the attempt log."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions import values as V
from pairwright.functions.prompts import ensure_json_instruction
from pairwright.functions.rules import pct
from pairwright.functions.text import as_column, is_blank, word_count
from pairwright.operators.responses import MODELS, fault_of, parse_responses
from pairwright.plans import scale

Provider = Callable[[list[dict]], str]
MESSAGE = "array<struct<role:string,content:string>>"
NO_CONTENT = "Empty response content"


def chat_messages(requests: DataFrame) -> Column:
    """The messages of a request: the system prompt, then its history or its one prompt.

    The system prompt gets the JSON instruction unless it speaks of JSON already.  Requests have
    ``system`` and ``history`` (an array of role and content) or ``prompt``, as far as they need them;
    where an interview has no history yet, its prompt opens it.
    """
    named = set(requests.columns)

    def message(role: str, content: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content"))).cast(MESSAGE)

    none = F.array().cast(MESSAGE)
    system = F.when(F.col("system").isNotNull(), message("system", ensure_json_instruction("system"))) if "system" in named else none
    prompt = F.when(F.col("prompt").isNotNull(), message("user", F.col("prompt"))) if "prompt" in named else none
    said = F.when(F.size("history") > 0, F.col("history").cast(MESSAGE)) if "history" in named else F.lit(None).cast(MESSAGE)
    return F.concat(F.coalesce(system, none), F.coalesce(said, prompt, none))


class Pauses:
    """Waits after failed calls, for each provider on its own and longer while it keeps failing."""

    def __init__(self, n: int, pause: float, backoff: float, longest: float):
        self.failures, self.lock = [0] * n, threading.Lock()
        self.pause, self.backoff, self.longest = pause, backoff, longest

    def after(self, rank: int, failed: bool) -> None:
        with self.lock:
            self.failures[rank] = self.failures[rank] + 1 if failed else 0
            wait = min(self.pause * self.backoff ** (self.failures[rank] - 1), self.longest) if failed else 0
        time.sleep(wait)


def _attempts(
    messages: list[dict], calls: Sequence[Provider], spec: dict, max_retries: int, pauses: Pauses
) -> list[tuple]:
    """(provider_rank, attempt, content, error) of the calls for one request, up to a valid answer."""
    made = []
    for rank, call in enumerate(calls):
        for attempt in range(1, max_retries + 1):
            content, error = None, None
            try:
                content = call(messages)
            except Exception as failure:  # a provider may fail in any way
                error = str(failure)
            if error is None:
                error = fault_of(content, spec) if content else NO_CONTENT
            made.append((rank, attempt, content, error))
            pauses.after(rank, error is not None)
            if error is None:
                return made
    return made


def call_providers(
    requests: DataFrame,
    providers: Sequence[Provider | Callable[[], Provider]],
    model: str | dict,
    max_retries: int = 1,
    pause: float = 1.0,
    factories: bool = False,
    partitions: int | None = None,
    concurrency: int = 1,
    backoff: float = 1.0,
    longest: float = 60.0,
) -> DataFrame:
    """(request_id, provider_rank, attempt, content, error): all calls, request by request.

    ``requests``: (request_id, messages), the id of any type.  Each request goes to the providers in
    order, ``max_retries`` times each, until an answer is valid under ``model``.  After every failed
    call, an invalid answer included, it waits ``pause`` seconds, ``backoff`` times longer with each
    further failure of that provider in a row.  A task has at most ``concurrency`` calls under way
    and holds one batch of requests.  With ``factories`` providers are built once per task, such
    as clients that cannot be pickled.
    """
    spec = MODELS[model] if isinstance(model, str) else model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = [p() if factories else p for p in providers]
        pauses = Pauses(len(calls), pause, backoff, longest)

        def one(messages: Sequence) -> list[tuple]:
            plain = [m if isinstance(m, dict) else m.asDict() for m in messages]
            return _attempts(plain, calls, spec, max_retries, pauses)

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                found = zip(batch["request_id"], pool.map(one, batch["messages"]), strict=True)
                made = [(key, *attempt) for key, attempts in found for attempt in attempts]
                yield pd.DataFrame(made, columns=["request_id", "provider_rank", "attempt", "content", "error"])

    key = requests.schema["request_id"].dataType
    rest = [("provider_rank", T.IntegerType()), ("attempt", T.IntegerType()), ("content", T.StringType()), ("error", T.StringType())]
    schema = T.StructType([T.StructField("request_id", key), *[T.StructField(*f) for f in rest]])
    rows = requests.select("request_id", "messages")
    if partitions:
        rows = rows.repartition(partitions, "request_id")
    return rows.mapInPandas(run, schema)


def first_valid_response(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """(request_id, content, provider_rank, status, last_error) per request.

    The first valid content by provider order and attempt wins.  Without one the
    status is 503 and the error is that of the last attempt.  Each task reduces
    its share of the log first, so a request with very many attempts is no burden.
    """
    order = F.struct("provider_rank", "attempt")
    valid = F.col("error").isNull() & (F.length("content") > 0)
    best = attempts.groupBy("request_id").agg(
        F.min_by(F.struct("content", "provider_rank"), F.when(valid, order)).alias("w"),
        F.max_by("error", order).alias("last_error"),
    )
    return requests.select("request_id").distinct().join(best, "request_id", "left").select(
        "request_id",
        F.col("w.content").alias("content"),
        F.col("w.provider_rank").alias("provider_rank"),
        F.when(F.col("w").isNotNull(), 200).otherwise(503).alias("status"),
        F.when(F.col("w").isNull(), F.col("last_error")).alias("last_error"),
    )


def complete_batch(
    requests: DataFrame, providers: Sequence[Provider], model: str | dict, max_retries: int = 1, pause: float = 1.0, **how
) -> tuple[DataFrame, DataFrame]:
    """(responses, attempts): structured completion with ordered fallback.

    ``requests`` have request_id and ``messages``, or what :func:`chat_messages` makes them of.  The texts
    are read once; the log of all calls is written once and answers everything after it.  A lost executor
    repeats the requests of its unfinished tasks: ``partitions`` says how many tasks there are.  ``how``
    goes to :func:`call_providers`.
    """
    messages = F.col("messages") if "messages" in requests.columns else chat_messages(requests)
    calls = call_providers(requests.select("request_id", messages.alias("messages")), providers, model, max_retries, pause, **how)
    # the answers are read by the column form of the validator, which has the last word
    checked = parse_responses(scale.materialize(calls, "calls"), "content", model, error="fault")
    error = F.coalesce("error", "fault")
    log = checked.select(
        "request_id", "provider_rank", "attempt",
        F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"),
    )
    log = scale.materialize(log, "attempts")
    return parse_responses(first_valid_response(requests, log), "content", model), log


def provider_health(attempts: DataFrame) -> DataFrame:
    """(provider_rank, attempts, failures, success_pct) per provider."""
    return (
        attempts.groupBy("provider_rank")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.count_if(F.col("error").isNotNull()).alias("failures"),
        )
        .withColumn("success_pct", pct(F.col("attempts") - F.col("failures"), "attempts"))
    )


def all_failed(attempts: DataFrame) -> DataFrame:
    """Requests of the log in which every attempt failed."""
    return (
        attempts.groupBy("request_id")
        .agg(F.bool_and(F.col("error").isNotNull()).alias("failed"))
        .filter("failed")
        .select("request_id")
    )


def check_channel_rules(kind: Column | str, subject: Column | str, content: Column | str) -> Column:
    """The channel rules a generated text breaks, as an array of codes."""
    k, n = as_column(kind), word_count(content)
    no_subject = is_blank(subject)
    codes = [
        F.when((k == channel) & (n >= limit), "too_long")
        for channel, limit in V.CHANNEL_WORD_LIMITS.items()
    ]
    codes.append(F.when(k.isin(*V.CHANNEL_WORD_LIMITS) & ~no_subject, "subject_not_allowed"))
    codes.append(F.when((k == "email") & no_subject, "subject_missing"))
    return F.array_compact(F.array(*codes))

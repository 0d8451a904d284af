"""From search hits to an answer: validation, context, citations, history, prompt, generation, response."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.text import default_if_empty, py_strip
from clausewright.runtime import materialize

# What separates sections, and the names and texts shown where nothing is known.
SEPARATOR = "\n\n---\n\n"
NO_CONTEXT = "No section of the by-laws fits this question."
STORE_DOWN = "The chunk store gave no results."
STORE_DOWN_TEXT = "The by-laws cannot be searched at the moment. Please ask again later."
MODEL_DOWN = "The language model gave no answer."
MODEL_DOWN_TEXT = "No answer could be written at the moment. These are the sections that fit the question best."
NO_RESPONSE = "No response generated."
SOURCE = "array<struct<title:string,bylaw_id:string,pdf_url:string>>"


def route_city(requests: DataFrame, registry: DataFrame, city: str = "city") -> DataFrame:
    """requests with `collection`, null for a city that is not registered (case and spaces count)."""
    reg = registry.groupBy(F.col("city").alias("_city")).agg(F.min("collection").alias("collection"))
    return requests.join(reg, requests[city] == reg["_city"], "left").drop("_city")


def validate(requests: DataFrame, query: str = "query") -> DataFrame:
    """routed requests with `error`: first a body that is no JSON (where a column is_json tells), then the unknown city, then the
    empty query, else null."""
    broken = ~F.col("is_json") if "is_json" in requests.columns else F.lit(False)
    blank = F.coalesce(F.length(py_strip(query)), F.lit(0)) == 0
    return requests.withColumn("error", F.when(broken, F.lit("not json")).when(F.col("collection").isNull(), F.lit("unknown city")).when(blank, F.lit("empty query")))


def context_text(hits: DataFrame, query_id: str = "query_id", rank: str = "rank", text: str = "chunk_text") -> DataFrame:
    """(query_id, context): the non-empty chunks of at most k hits in the order of rank."""
    return hits.filter(F.coalesce(F.length(text), F.lit(0)) > 0).groupBy(query_id).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda x: x[text]), SEPARATOR).alias("context")
    )


def source_list(hits: DataFrame, query_id: str = "query_id", rank: str = "rank", title: str = "bylaw_title", bylaw: str = "bylaw_id", url: str = "url") -> DataFrame:
    """(query_id, sources): citations in the order of rank, repeats kept."""
    src = F.struct(F.col(rank).alias("rank"), F.struct(F.col(title).alias("title"), F.col(bylaw).alias("bylaw_id"), F.col(url).alias("pdf_url")).alias("s"))
    return hits.groupBy(query_id).agg(F.transform(F.array_sort(F.collect_list(src)), lambda x: x["s"]).alias("sources"))


def distinct_sources(sources: Column, n: int | None = 5) -> Column:
    """The first citation of each title, without a title left out; the first n of them."""
    titled = F.filter(sources, lambda s: s["title"].isNotNull())
    first = F.filter(titled, lambda s, i: F.array_position(F.transform(titled, lambda x: x["title"]), s["title"]) == i + 1)
    return F.slice(first, 1, n) if n else first


def source_label(title: Column, bylaw: Column) -> Column:
    """`title (id)`; 'Source' for a null title; the id without its first 'Chapter ', no brackets without an id."""
    short = F.coalesce(F.regexp_replace(bylaw, r"(?s)^(.*?)Chapter ", "$1"), F.lit(""))
    return F.trim(F.concat(F.coalesce(title, F.lit("Source")), F.lit(" "), F.when(short != "", F.concat(F.lit("("), short, F.lit(")"))).otherwise(F.lit(""))))


def speaker_line(from_me: Column, text: Column) -> Column:
    return F.concat(F.when(F.coalesce(from_me, F.lit(False)), F.lit("User")).otherwise(F.lit("AI")), F.lit(": "), F.coalesce(text, F.lit("None")))


def finished(messages: Column) -> Column:
    """The messages that are not still loading."""
    return F.filter(messages, lambda m: ~F.coalesce(m["isLoading"], F.lit(False)))


def sent_messages(messages: Column, n: int = 3, mode: str = "first") -> Column:
    """The messages that go along: the first n, or the last n."""
    if mode not in ("first", "last"):
        raise ValueError("mode is first or last")
    return F.slice(messages, 1, n) if mode == "first" else F.slice(messages, F.greatest(F.lit(1), F.size(messages) - n + 1), n)


def history_text(messages: Column) -> Column:
    """Speaker lines joined by line ends; '' for no messages."""
    return F.coalesce(F.array_join(F.transform(messages, lambda m: speaker_line(m["fromMe"], m["text"])), "\n"), F.lit(""))


#: What the model is told, in order; {day} is the day of the question.
INSTRUCTIONS = (
    "Answer in three to six sentences unless the question asks for more; bullet points are welcome where they help.",
    "Name the exact figures, limits and conditions that the sections give.",
    "Where no section settles the question, offer what comes closest to it in them.",
    "Where the question refers to something said before, sum that up from the conversation.",
    "Where nothing given can answer it, say which information there is and that it does not suffice.",
    "Sections may begin or end in mid-word; complete such words so that the answer reads well.",
    "Rather be clear and right than guess.",
    "Of fees with several effective dates use the one in force on {day}; give past amounts only if they are asked for.",
)


def prompt_text(query: Column, context: Column, city: Column, history: Column, today: Column) -> Column:
    """The prompt: role, sections found, question, history, instructions with the date (given, so that runs repeat)."""
    rules = "\n".join(f"{i}. {x}" for i, x in enumerate(INSTRUCTIONS, 1)).split("{day}")
    return F.concat(
        F.lit("You help residents of "), default_if_empty(city, "the city"), F.lit(" understand municipal by-laws.\n\nSections found:\n"), default_if_empty(context, NO_CONTEXT),
        F.lit("\n\nQuestion:\n"), default_if_empty(query, "(no question)"), F.lit("\n\nConversation so far, oldest first:\n"), default_if_empty(history, "(none)"),
        F.lit("\n\nInstructions:\n" + rules[0]), F.date_format(today, "MMMM dd, yyyy"), F.lit(rules[1]),
    )


@dataclass(frozen=True)
class Sampling:
    """Settings handed to the model with every prompt."""

    temperature: float = 0.5
    top_p: float = 0.95
    top_k: int = 40
    max_output_tokens: int = 512


def extractive(prompt: str, settings: Sampling = Sampling()) -> Iterator[str]:
    """Stand-in for a language model: the beginning of the first section found, in pieces of some words."""
    body = prompt.split("Sections found:\n", 1)[-1].split("\n\nQuestion:", 1)[0]
    said = body.split(SEPARATOR)[0][: settings.max_output_tokens]
    for at in range(0, len(said), 64):
        yield said[at : at + 64]


Model = Callable[[str, Sampling], Iterable[str]]


def generate(prompt: Column, model: Model = extractive, settings: Sampling = Sampling()) -> Column:
    """struct(text, error): the model's pieces joined, or its error; an empty answer is a fixed text."""

    @F.pandas_udf("text string, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            rows = []
            for p in s:
                try:
                    pieces = model(p, settings) if p is not None else ()
                    rows.append(("".join(x for x in pieces if x) or NO_RESPONSE, None))
                except Exception as e:
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["text", "error"])

    return run(prompt)


def response(hits: Column, text: Column, error: Column, sources: Column, city: Column, at: Column) -> Column:
    """The response struct: degraded without hits or with a model error, else ok."""
    none, failed = F.coalesce(hits, F.lit(0)) == 0, error.isNotNull()
    return F.struct(
        F.when(none | failed, "degraded").otherwise("ok").alias("status"),
        F.when(none, STORE_DOWN).when(failed, MODEL_DOWN).alias("message"),
        F.when(none, STORE_DOWN_TEXT).when(failed, MODEL_DOWN_TEXT).otherwise(text).alias("ai_response"),
        F.when(~none, error).alias("ai_error"),
        F.when(none, F.array().cast(SOURCE)).otherwise(sources).alias("retrieved_sources"),
        city.alias("city"), at.alias("timestamp"),
    )


def response_json(r: Column) -> Column:
    """JSON with its null fields."""
    return F.to_json(r, {"ignoreNullFields": "false"})


def city_request_body(city: Column, email: Column, notes: Column) -> Column:
    """The mail's body; null where the city is missing (null or '')."""
    body = F.concat(F.lit("City request:\n\nCity: "), city, F.lit("\nEmail: "), default_if_empty(email, "N/A"), F.lit("\nNotes: "), default_if_empty(notes, "N/A"))
    return F.when(F.nullif(city, F.lit("")).isNotNull(), body)


def feedback_body(feedback: Column, email: Column) -> Column:
    body = F.concat(F.lit("Feedback:\n\n"), feedback, F.lit("\n\nFrom: "), default_if_empty(email, "Anonymous"))
    return F.when(F.nullif(feedback, F.lit("")).isNotNull(), body)


# What a refused request is told, by the error of `validate`.
REFUSED = {"not json": "Request must be JSON", "unknown city": "City Not found", "empty query": "Missing 'query' in request body"}


def refusal(error: Column) -> Column:
    """The body of a refused request."""
    told = F.coalesce(*(F.when(error == k, v) for k, v in REFUSED.items()))
    return F.to_json(F.struct(F.lit("error").alias("status"), F.struct(told.alias("message")).alias("error")))


def answer(requests: DataFrame, hits: DataFrame, today: Column, model: Model = extractive, settings: Sampling = Sampling()) -> DataFrame:
    """(query_id, response) for a batch of valid requests(query_id, query, city, conversation_context, timestamp) with
    their hits. All up to the model call is one lazy plan."""
    found = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    r = requests.join(found, "query_id", "left").join(context_text(hits), "query_id", "left").join(source_list(hits), "query_id", "left")
    prompt = prompt_text(F.col("query"), F.col("context"), F.col("city"), history_text(F.col("conversation_context")), today)
    r = r.withColumn("said", generate(prompt, model, settings))
    return r.select("query_id", response(F.col("n_hits"), F.col("said.text"), F.col("said.error"), F.col("sources"), F.col("city"), F.col("timestamp")).alias("response"))


def log_lines(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """What the log keeps of each answer: a degraded one as it was given, without the query; another with the query and without status and
    message. The columns are those of schema.LOG."""
    r, ok = F.col("response"), F.col("response.status") == "ok"
    rows = answers.join(requests.select("query_id", "query"), "query_id")
    shape = F.struct(F.when(~ok, r["status"]).alias("status"), F.when(~ok, r["message"]).alias("message"), *(r[c].alias(c) for c in ("ai_response", "ai_error", "retrieved_sources", "city", "timestamp")), F.when(ok, F.col("query")).alias("query"))
    return rows.select("query_id", shape.alias("line")).select("query_id", "line.*")


def serve(requests: DataFrame, registry: DataFrame, search: Callable[[DataFrame], DataFrame], today: Column, model: Model = extractive, settings: Sampling = Sampling()) -> tuple[DataFrame, DataFrame]:
    """(replies, log) of a batch of decoded requests(query_id, query, city, conversation_context, timestamp).

    replies(query_id, http_status, body): 400 with the first error for an unknown city or a blank query, else 200 with the
    answer's JSON. log: the lines of the answers that were given. search gets the valid requests with their `collection` and
    returns hits(query_id, rank, chunk_text, bylaw_title, bylaw_id, url); a request without hits gets the degraded answer. The
    answers are written once, so that the model is asked once for both results. Query ids must be distinct.
    """
    checked = materialize(validate(route_city(requests, registry)))
    valid = checked.filter("error is null").drop("error")
    answers = materialize(answer(valid, search(valid), today, model, settings))
    refused = checked.filter("error is not null").select("query_id", F.lit(400).alias("http_status"), refusal(F.col("error")).alias("body"))
    given = answers.select("query_id", F.lit(200).alias("http_status"), response_json(F.col("response")).alias("body"))
    return refused.union(given), log_lines(valid, answers)

"""Prompts, answers and their presentation."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docweft.config import Llm

NO_CONTEXT = "(Tidak ada konteks relevan ditemukan.)"
NO_ANSWER = "Maaf, dokumen yang diindeks tidak memuat konteks untuk pertanyaan ini."
SYSTEM = "Jawab hanya dari konteks. Sebut sumbernya. Bila konteks tidak memuat jawabannya, katakan demikian."


@F.pandas_udf(StringType())
def two_places(x: pd.Series) -> pd.Series:
    """Two decimals of the exact binary value, halves to even, as a float prints elsewhere."""
    return x.map(lambda v: None if v is None else str(Decimal(float(v)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)))


def source_label() -> Column:
    """Chapter, section where it differs, and page; the file name where there is none of them."""
    part = F.concat_ws(" > ", F.when(F.coalesce("chapter", F.lit("")) != "", F.col("chapter")), F.when((F.coalesce("section", F.lit("")) != "") & (F.col("section") != F.coalesce("chapter", F.lit(""))), F.col("section")), F.when(F.coalesce("page_start", F.lit(0)) > 0, F.concat(F.lit("hal. "), F.col("page_start").cast("string"))))
    return F.when(part != "", part).otherwise(F.col("filename"))


def contexts(hits: DataFrame, query_key: str = "query_id") -> DataFrame:
    """``query_key, context``: the numbered passages of each query in order of rank."""
    one = F.concat(F.lit("[Konteks "), F.col("rank").cast("string"), F.lit("] (Sumber: "), source_label(), F.lit(", skor: "), two_places(F.col("score")), F.lit(")\n"), F.col("text"))
    got = hits.withColumn("_dw_line", one).groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("rank", "_dw_line"))).alias("x"))
    return got.select(query_key, F.array_join(F.transform("x", lambda v: v["_dw_line"]), "\n\n").alias("context"))


def prompts(questions: DataFrame, hits: DataFrame, query_key: str = "query_id") -> DataFrame:
    """``query_key, question, n_hits, system, user`` of every question, those without hits included."""
    n = hits.groupBy(query_key).agg(F.count("*").alias("n_hits"))
    q = questions.join(contexts(hits, query_key), query_key, "left").join(n, query_key, "left")
    user = F.concat(F.lit("Konteks dari dokumen:\n\n"), F.coalesce("context", F.lit(NO_CONTEXT)), F.lit("\n\n---\nPertanyaan: "), F.col("question"))
    return q.select(query_key, "question", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.lit(SYSTEM).alias("system"), user.alias("user"))


def echo(cfg: Llm) -> Callable[[Column, Column], Column]:
    """A stand-in that repeats the head of the question; it makes runs without a model the same everywhere."""
    return lambda system, user: F.concat(F.lit("[MOCK ANSWER] Berdasarkan konteks, jawaban untuk: "), F.substring(user, 1, 50))


def remote(cfg: Llm) -> Callable[[Column, Column], Column]:
    if importlib.util.find_spec("openai") is None:
        raise RuntimeError("openai is not installed")

    @F.pandas_udf("string")
    def run(system: pd.Series, user: pd.Series) -> pd.Series:
        from openai import OpenAI

        client = OpenAI(api_key=cfg.api_key or "none", base_url=cfg.api_base or None)
        ask = lambda s, u: client.chat.completions.create(model=cfg.model, temperature=cfg.temperature, max_tokens=cfg.max_tokens, messages=[{"role": "system", "content": s}, {"role": "user", "content": u}]).choices[0].message.content
        return pd.Series([ask(s, u) for s, u in zip(system, user)])

    return run


def local(cfg: Llm) -> Callable[[Column, Column], Column]:
    if importlib.util.find_spec("transformers") is None:
        raise RuntimeError("transformers is not installed")

    @F.pandas_udf("string")
    def run(system: pd.Series, user: pd.Series) -> pd.Series:
        from transformers import pipeline

        model = pipeline("text-generation", model=cfg.model)
        more = {"do_sample": True, "temperature": cfg.temperature} if cfg.temperature > 0 else {"do_sample": False}
        return pd.Series([model([{"role": "system", "content": s}, {"role": "user", "content": u}], max_new_tokens=cfg.max_tokens, **more)[0]["generated_text"][-1]["content"] for s, u in zip(system, user)])

    return run


REGISTRY = {"echo": echo, "openai": remote, "custom": remote, "local": local}


def get_llm(cfg: Llm = Llm()) -> Callable[[Column, Column], Column]:
    if cfg.provider not in REGISTRY:
        raise ValueError(f"no model provider {cfg.provider!r}")
    return REGISTRY[cfg.provider](cfg)


def answers(prompted: DataFrame, llm: Callable[[Column, Column], Column], model: str = "") -> DataFrame:
    """``… , answer, model``: questions without hits get a fixed sentence, and the model is not called for them."""
    asked = prompted.where("n_hits > 0").withColumn("answer", llm(F.col("system"), F.col("user")))
    return asked.unionByName(prompted.where("n_hits = 0").withColumn("answer", F.lit(NO_ANSWER))).withColumn("model", F.lit(model))


def chat_template(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, prompt``: ROLE, a line break and the content, blocks parted by a blank line, then the assistant's turn."""
    block = F.concat(F.upper("role"), F.lit(":\n"), F.col("text"))
    got = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("x"))
    return got.select(key, F.concat(F.array_join(F.transform("x", lambda v: v["b"]), "\n\n"), F.lit("\n\nASSISTANT:\n")).alias("prompt"))


#: Characters of a source's text and decimals of its score, by surface.
SURFACES = {"answer": (300, 4), "api": (500, 4), "ui": (200, 3), "cli": (150, 4)}


def sources(hits: DataFrame, surface: str = "answer") -> DataFrame:
    """Hits as a surface shows them."""
    n, places = SURFACES[surface]
    return hits.withColumn("text", F.substring("text", 1, n)).withColumn("score", F.round("score", places))

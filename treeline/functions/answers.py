"""Reading JSON out of model answers: the one thing here that needs a parser rather than an expression."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_DECODER = json.JSONDecoder()


def _spoken(answer: str | None) -> str:
    """The answer without reasoning blocks, closed or not."""
    return re.sub(r"(?s)<think>.*?(?:</think>|$)", "", answer or "").strip()


def _fenced(text: str) -> str:
    begin = text.find("```json")
    body = text[begin + 7 :] if begin >= 0 else text
    end = body.rfind("```")
    return (body[:end] if end >= 0 else body).strip()


def _attempts(text: str) -> Iterator[str]:
    """Ever more forgiving versions of what should be JSON."""
    yield text
    squeezed = " ".join(text.replace("None", "null").split())
    yield squeezed
    yield re.sub(r",\s*([\]}])", r"\1", squeezed)
    yield re.sub(r"}\s*{", "}, {", re.sub(r",\s*([\]}])", r"\1", squeezed))


def first_json(answer: str | None):
    """The first complete JSON value of an answer, lightly repaired; {} if there is none."""
    text = _spoken(answer)
    if not text:
        return {}
    if "```json" in text:
        text = _fenced(text)
    else:
        starts = [i for i in (text.find("["), text.find("{")) if i >= 0]
        text = text[min(starts, default=0) :]
    for attempt in _attempts(text.strip()):
        try:
            return _DECODER.raw_decode(attempt)[0]
        except json.JSONDecodeError:
            continue
    return {}


def complete_objects(answer: str | None) -> list[dict]:
    """Every complete object of a list that may be cut off; a table_of_contents inside is opened."""
    text = _spoken(answer)
    if text.startswith("```"):
        text = _fenced(text)
    opened = lambda v: [x for x in v.get("table_of_contents", [v]) if isinstance(x, dict)] if isinstance(v.get("table_of_contents", []), list) else [v]
    try:
        whole = _DECODER.raw_decode(text)[0]
        if isinstance(whole, list):
            return [x for x in whole if isinstance(x, dict)]
        if isinstance(whole, dict) and "table_of_contents" in whole:
            return opened(whole)
    except json.JSONDecodeError:
        pass
    out, at = [], text.find("{")
    while at >= 0:
        try:
            value, used = _DECODER.raw_decode(text[at:])
            out += opened(value)
            at = text.find("{", at + used)
        except json.JSONDecodeError:
            at = text.find("{", at + 1)
    return out


@F.pandas_udf(StringType())
def extract_json(answers: pd.Series) -> pd.Series:
    return answers.map(lambda a: json.dumps(first_json(a), ensure_ascii=False))


@F.pandas_udf(ArrayType(StringType()))
def salvage_objects(answers: pd.Series) -> pd.Series:
    return answers.map(lambda a: [json.dumps(x, ensure_ascii=False) for x in complete_objects(a)])

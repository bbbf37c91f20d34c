"""JSON read out of a model's answer, mended where it has to be."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Where JSON is looked for in an answer, and how pairs of a name and a value are written, in order.
FOUND = (r"\{[^{}]*\}", r"\{(?:[^{}]|(?:\{[^{}]*\}))*\}", r"```json\s*(.*?)\s*```", r"```\s*(.*?)\s*```")
PAIRS = (r'"?(\w+)"?\s*:\s*"([^"]*)"', r'"?(\w+)"?\s*:\s*([^,}\s]+)', r'(\w+)\s*=\s*"([^"]*)"', r"(\w+)\s*=\s*([^,\s]+)")


def inner(text: str) -> str | None:
    """The longest match (of equals the first) of the first pattern that has any; else from the first brace to the last."""
    for pattern in FOUND:
        if found := re.findall(pattern, text, re.DOTALL):
            return max(found, key=len)
    begin, end = text.find("{"), text.rfind("}")
    return text[begin : end + 1] if 0 <= begin < end else None


def cleaned(text: str) -> str:
    """Without fences and what comes before the first brace; double quotes, quoted names, no trailing commas."""
    steps = ((r"```(?:json)?\s*", ""), (r"```\s*$", ""), (r"(?s)\A.*?(?=\{)", ""), ("'", '"'), (r"(\w+):", r'"\1":'), (r",\s*}", "}"), (r",\s*]", "]"))
    for pattern, by in steps:
        text = re.sub(pattern, by, text)
    return text.strip()


def requoted(text: str) -> str:
    return re.sub(r"(\w+):\s*", r'"\1": ', re.sub(r"'([^']*)'", r'"\1"', text))


def braced(text: str) -> str:
    text = text if text.startswith("{") else "{" + text
    return re.sub(r"}\s*{", "}, {", text if text.endswith("}") else text + "}")


def pairs(text: str) -> str:
    """An object of all pairs of a name and a value; of those of one name the last pattern's last."""
    return json.dumps({name: value for p in PAIRS for name, value in re.findall(p, text)})


def repaired(text: str) -> str:
    """The first attempt that parses, written anew. Pairs always do, if only as an empty object."""
    found = inner(text)
    source = found or text
    attempts = (lambda: text, lambda: found or text, lambda: cleaned(text), lambda: source, lambda: cleaned(source), lambda: requoted(source), lambda: braced(source), lambda: pairs(source))
    for attempt in attempts:
        try:
            return json.dumps(json.loads(attempt()), ensure_ascii=False)
        except ValueError:
            continue
    return "{}"


@pandas_udf(StringType())
def json_repaired(texts: pd.Series) -> pd.Series:
    """The JSON of each text; null for null."""
    return texts.map(lambda t: None if t is None else repaired(t))

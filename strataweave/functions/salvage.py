"""JSON out of a model's answer."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCED = re.compile(r"```(?:json)?\s*([\[{].*?[\]}])\s*```", re.S)
_OBJECT, _ARRAY = re.compile(r"\{.*\}", re.S), re.compile(r"\[.*\]", re.S)


def salvage_json(text: str | None):
    """The answer itself if it is JSON, else a fenced block, else the outermost object, else the outermost array; None if none of
    them can be read."""
    text = (text or "").strip()
    tries = [text] + [m[m.lastindex or 0] for p in (_FENCED, _OBJECT, _ARRAY) if (m := p.search(text))]
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def salvage_json_udf(s: pd.Series) -> pd.Series:
    """The salvaged JSON with sorted keys, as text; null if there is none."""
    found = s.map(salvage_json)
    return found.map(lambda v: None if v is None else json.dumps(v, sort_keys=True, ensure_ascii=False))

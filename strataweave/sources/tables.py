"""Tables from files and strings. Files are read by Spark; one small pasted table is parsed on the driver."""

from __future__ import annotations

import csv
import io
import json
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that holds a row's place in its source, from 0.
ROW_ID = "_row"


def unique_headers(headers: list[str]) -> list[str]:
    """Blank headers get their position, repeated ones a counter."""
    out: list[str] = []
    for i, h in enumerate(headers):
        name = h.strip() or f"column_{i + 1}"
        k, base = 2, name
        while name in out or name == ROW_ID:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def grid(spark: SparkSession, headers: list[str], rows: list[list[str]]) -> DataFrame:
    """A parsed table as strings; short rows are filled with blanks, wholly blank ones dropped."""
    width = max([len(headers), *(len(r) for r in rows)], default=0)
    names = unique_headers([*headers, *[""] * (width - len(headers))])
    kept = [[*r, *[""] * (width - len(r))] for r in rows if any(str(c).strip() for c in r)]
    schema = f"{ROW_ID} long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names) if names else f"{ROW_ID} long"
    return spark.createDataFrame([(i, *map(str, r)) for i, r in enumerate(kept)], schema)


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file of any size as strings (roles come from value shapes, so nothing is inferred)."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', inferSchema=False)
    return df.toDF(*unique_headers([re.sub(r"^_c[0-9]+$", "", c) for c in df.columns]))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def sniff_delimiter(text: str) -> str:
    try:
        return csv.Sniffer().sniff(text[:2048], ",\t;|").delimiter
    except csv.Error:
        return ","


def parse_csv(text: str, sep: str | None = None) -> tuple[list[str], list[list[str]]]:
    rows = [r for r in csv.reader(io.StringIO(text.strip("\n")), delimiter=sep or sniff_delimiter(text)) if any(c.strip() for c in r)]
    cells = [[c.strip() for c in r] for r in rows]
    return (cells[0], cells[1:]) if cells else ([], [])


def parse_markdown(text: str) -> tuple[list[str], list[list[str]]]:
    """A pipe table; the divider row is optional and an escaped pipe is text."""
    rows = []
    for line in text.splitlines():
        if "|" in line:
            inner = line.strip()
            inner = inner[1:] if inner.startswith("|") else inner
            inner = inner[:-1] if inner.endswith("|") and not inner.endswith("\\|") else inner
            cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                rows.append(cells)
    return (rows[0], rows[1:]) if rows else ([], [])


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.heads: list[bool] = []
        self.depth, self.done, self.cell = 0, False, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and not self.done:
            if tag == "tr":
                self.rows.append([])
                self.heads.append(False)
            elif tag in ("td", "th") and self.rows:
                self.cell = []
                self.heads[-1] |= tag == "th"

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
            self.done |= self.depth == 0
        elif tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def parse_html(text: str) -> tuple[list[str], list[list[str]]]:
    """The first table; its first row with a th is the header, else its first row."""
    p = _Tables()
    p.feed(text)
    rows = [(h, r) for h, r in zip(p.heads, p.rows, strict=True) if r]
    if not rows:
        return [], []
    at = next((i for i, (h, _) in enumerate(rows) if h), 0)
    return rows[at][1], [r for i, (_, r) in enumerate(rows) if i != at]


def parse_json(text: str) -> tuple[list[str], list[list[str]]]:
    """Records, arrays, {headers, rows}, {columns, data}, or a dict of lists."""
    data = json.loads(text)
    say = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if isinstance(data, dict):
        for h, r in (("headers", "rows"), ("columns", "data")):
            if h in data and r in data:
                body = [[say(x.get(c)) for c in data[h]] if isinstance(x, dict) else [say(c) for c in x] for x in data[r]]
                return [str(x) for x in data[h]], body
        if data and all(isinstance(v, list) for v in data.values()):
            n = max(map(len, data.values()))
            return list(data), [[say(v[i]) if i < len(v) else "" for v in data.values()] for i in range(n)]
        data = [data]
    if data and all(isinstance(x, dict) for x in data):
        heads = list(dict.fromkeys(k for x in data for k in x))
        return heads, [[say(x.get(h)) for h in heads] for x in data]
    rows = [[say(c) for c in x] for x in data if isinstance(x, list)]
    return (rows[0], rows[1:]) if rows else ([], [])


PARSERS = {"csv": parse_csv, "tsv": lambda t: parse_csv(t, "\t"), "markdown": parse_markdown, "html": parse_html, "json": parse_json}


def detect_format(text: str) -> str:
    t = text.strip()
    lines = [x for x in t.splitlines() if x.strip()]
    if t[:1] in "{[" and t:
        try:
            json.loads(t)
            return "json"
        except ValueError:
            pass
    if "<table" in t.lower():
        return "html"
    if lines and 2 * sum("|" in x for x in lines) >= len(lines) and (lines[0].lstrip().startswith("|") or lines[0].count("|") > lines[0].count(",")):
        return "markdown"
    return "tsv" if lines and "\t" in lines[0] else "csv"


def parse_table(spark: SparkSession, text: str, hint: str | None = None) -> DataFrame:
    """A pasted table of any known format as strings with a row number."""
    return grid(spark, *PARSERS[hint or detect_format(text)](text))


def parse_light(text: str) -> tuple[list[str], list[list[str]]]:
    """A pasted table without a hint: lines that start with a pipe make it Markdown, a tab in the first line TSV, else CSV.

    Rows of a pipe table are cut or filled to the header's width; rows of blanks are dropped from the others.
    """
    lines = [x.strip() for x in text.strip().splitlines() if x.strip()]
    piped = [x for x in lines if x.startswith("|") and not re.fullmatch(r"\|[\s\-:|]+\|", x)]
    if piped:
        heads, *rows = ([c.strip() for c in x.strip("|").split("|")] for x in piped)
        return heads, [(r + [""] * len(heads))[: len(heads)] for r in rows]
    rows = list(csv.reader(io.StringIO(text.strip()), delimiter="\t" if lines and "\t" in lines[0] else ","))
    return ([h.strip() for h in rows[0]], [[c.strip() for c in r] for r in rows[1:] if any(c.strip() for c in r)]) if rows else ([], [])


#: Rows that a table put out as one string may have.
MOST_ROWS = 100_000


def _small(table: DataFrame) -> tuple[list[str], list]:
    names = [c for c in table.columns if c != ROW_ID]
    rows = table.select(*(F.col(f"`{c}`") for c in names)).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows: write files instead")
    return names, rows


def to_markdown(table: DataFrame) -> str:
    """A small table as a pipe table; a larger one than MOST_ROWS raises ValueError."""
    names, rows = _small(table)
    line = lambda cells: "| " + " | ".join(str("" if c is None else c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *(line(r) for r in rows)])


def to_csv(table: DataFrame) -> str:
    """A small table as CSV text; a larger one than MOST_ROWS raises ValueError (``df.write.csv`` has no such bound)."""
    names, rows = _small(table)
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(names)
    w.writerows(rows)
    return out.getvalue()

"""Paragraphs, sentences, packed ids and length bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LENGTH_MOST = 65535
EDGES = (16, 32, 64, 128, 256, 512, 1024)
ABBREVIATIONS = "Dr. Mr. Mrs. Ms. Prof. Sr. Jr. vs. etc. approx. e.g. i.e. vol. dept. Gen. Gov. Sgt. Cpl. Pvt. St. Ave. Blvd. Jan. Feb. Mar. Apr. Aug. Sep. Oct. Nov. Dec. U.S. U.K. No. Fig. Ref. a.m. p.m.".split()
#: Bits of a packed id from the lowest: line in paragraph, length, paragraph in document, shard, document in shard.
FIELDS = {"para_line": 16, "char_len": 16, "doc_para_num": 18, "shard_num": 14, "shard_doc_num": 16}
_ENDS = "(?:^| )(?:" + "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS) + ")$"


def trimmed(text: Column) -> Column:
    """Without any Unicode white space at its ends."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)^\\s+", ""), "(?U)\\s+$", "")


def paragraphs(text: Column | str) -> Column:
    """The lines of a text, trimmed, empty ones left out; CR and CRLF are line ends too."""
    lines = F.split(F.regexp_replace(F.col(text) if isinstance(text, str) else text, "\r\n?", "\n"), "\n")
    return F.filter(F.transform(lines, trimmed), lambda p: p != "")


def sentences(text: Column | str) -> Column:
    """Sentences of a paragraph: cut behind . ! ? (with quotes and brackets that close) before white space, or behind the CJK full stops; what ends with an abbreviation is joined to what follows.

    A rule of regular expressions, in place of a locale's break iterator, which there is none of on the JVM's SQL side.
    """
    c = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.regexp_replace(c, "(?U)([.!?…]+[\"'”’)\\]]*)(?=\\s)|([。！？])", "$1$2\u0001"), "\u0001")
    # pieces keep their leading spaces, so that joining two of them gives the text back
    joined = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((F.size(acc) > 0) & F.regexp_like(trimmed(F.element_at(acc, -1)), F.lit(_ENDS)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), p)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.filter(F.transform(joined, trimmed), lambda s: s != "")


def sentence_rows(docs: DataFrame, shard: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, shard_num, doc_para_num, para_line, char_len, text): a row for each sentence, numbers from 0, lengths clamped. A null text has none."""
    paras = docs.select(id_column, (F.col(shard) if shard else F.lit(0)).cast("int").alias("shard_num"), F.posexplode(paragraphs(text_column)).alias("doc_para_num", "__p"))
    rows = paras.select(id_column, "shard_num", "doc_para_num", F.posexplode(sentences("__p")).alias("para_line", "text"))
    return rows.select(id_column, "shard_num", "doc_para_num", "para_line", clamp_length(F.length("text")).cast("int").alias("char_len"), "text")


def clamp_length(n: Column) -> Column:
    return F.least(F.lit(LENGTH_MOST), F.greatest(F.lit(0), n))


def pack_id() -> Column:
    """The 80-bit id of columns FIELDS as DECIMAL(25,0); null where one is out of range."""
    total, shift, good = F.lit(0).cast("decimal(25,0)"), 0, F.lit(True)
    for name, bits in FIELDS.items():
        total = total + F.col(name).cast("decimal(25,0)") * F.lit(str(1 << shift)).cast("decimal(25,0)")
        good &= F.col(name).between(0, (1 << bits) - 1)
        shift += bits
    return F.when(good, total.cast("decimal(25,0)"))


def unpack_id(packed: Column) -> list[Column]:
    """The FIELDS of a packed id."""
    # remainders and exact divisions only: the quotient of two long decimals is rounded
    number = lambda n: F.lit(str(n)).cast("decimal(25,0)")
    out, shift = [], 0
    for name, bits in FIELDS.items():
        upto = packed.cast("decimal(25,0)") % number(1 << shift + bits)
        out.append(((upto - upto % number(1 << shift)) / number(1 << shift)).cast("long").alias(name))
        shift += bits
    return out


def check_edges(edges: Sequence[int]) -> None:
    if not edges or min(edges) < 1 or max(edges) > LENGTH_MOST or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError(f"edges must rise strictly within 1 .. {LENGTH_MOST}: {edges}")


def bucket(length: Column | str, edges: Sequence[int] = EDGES) -> Column:
    """The band of a length, from 0; band i holds edges[i-1] <= length < edges[i]."""
    check_edges(edges)
    c = F.col(length) if isinstance(length, str) else length
    return sum(((c >= e).cast("int") for e in edges), F.lit(0))


def band_label(length: Column | str, edges: Sequence[int] = EDGES) -> Column:
    check_edges(edges)
    c = F.col(length) if isinstance(length, str) else length
    label = F.when(c < edges[0], f"[0,{edges[0]})")
    for a, b in zip(edges, edges[1:]):
        label = label.when(c < b, f"[{a},{b})")
    return label.when(c >= edges[-1], f"[{edges[-1]},inf)")


def document_order(rows: DataFrame, by: str = "shard_num") -> DataFrame:
    """rows(path) with shard_doc_num, the place of the file within its shard in order of path."""
    return rows.withColumn("shard_doc_num", (F.row_number().over(Window.partitionBy(by).orderBy("path")) - 1).cast("int"))


def looks_like_json(text: Column | str) -> Column:
    c = trimmed(F.col(text) if isinstance(text, str) else text)
    pair = lambda a, b: c.startswith(a) & c.endswith(b)
    return F.coalesce((F.length(c) >= 2) & (pair("{", "}") | pair("[", "]")), F.lit(False))


def duration(seconds: Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))


def json_escape(text: Column | str) -> Column:
    """The text as the inside of a JSON string."""
    return _inside(F.to_json(F.array(F.col(text) if isinstance(text, str) else text)))


def _inside(array: Column) -> Column:
    return F.substring(array, F.lit(3), F.length(array) - 4)


def json_unescape(inside: Column | str) -> Column:
    """The text that the inside of a JSON string stands for; null if it is none."""
    c = F.col(inside) if isinstance(inside, str) else inside
    return F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>")[0]


def progress_bar(done: Column | str, total: Column | str, width: int = 24) -> Column:
    """[####----] of a share, which is kept within 0 and 1; a total of 0 or less is empty."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    share = F.when(c(total) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(done) / c(total)))).otherwise(0.0)
    full = F.floor(share * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full), F.lit("]"))


def epoch_ms(ts: Column | str) -> Column:
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def monitor_time(line: Column | str) -> Column:
    """The time that a board monitor's line begins with (month-day-year hour:minute:second); null without one."""
    found = F.regexp_extract(line, r"^(\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("MM-dd-yyyy HH:mm:ss"))


def truthy(flag: Column | str) -> Column:
    """Whether a setting says 1, true, yes or on, in any case; null says no."""
    return F.coalesce(F.lower(F.trim(flag)).isin("1", "true", "yes", "on"), F.lit(False))


JOB_JSON, JOB_NUMBERS = ("payload", "result", "error"), ("created_ts", "updated_ts", "ttl_s")


def job_from_hash(columns: dict[str, Column]) -> list[Column]:
    """The fields of a job from the strings of its hash: an empty payload is {}, an empty result or error null, JSON that can't be read {"_raw": ...}; numbers that can't be read are null."""
    out = []
    for name, c in columns.items():
        if name in JOB_JSON:
            empty = F.lit("{}") if name == "payload" else F.lit(None).cast("string")
            raw = F.to_json(F.struct(c.alias("_raw")))
            out.append(F.when(c.isNull() | (c == ""), empty).when(F.try_parse_json(c).isNull(), raw).otherwise(c).alias(name))
        else:
            out.append((c.try_cast("long") if name in JOB_NUMBERS else c).alias(name))
    return out


def job_to_hash(columns: dict[str, Column]) -> list[Column]:
    """The strings of a job's hash: null is an empty string, and null JSON is null."""
    return [F.coalesce(c.cast("string"), F.lit("null" if name in JOB_JSON else "")).alias(name) for name, c in columns.items()]

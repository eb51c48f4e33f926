"""Personal data by anchor expansion.

One Aho-Corasick scan of a text finds the anchors: at-signs, plus signs, digits, schemes and identifier cues. From
each anchor a local parser expands to the left and right, and validates what it covers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import lean, merged, pick, texts, type_of

#: The kinds in the order in which spans are listed; the last three are found beside the base kinds.
KINDS = ("email", "ip", "card", "phone", "login", "account", "secret")
BASE = KINDS[:4]

# What the base kinds look like.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Schemes and cues, and what may follow them.
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://", "mongodb://", "amqp://")
ACCOUNT_CUES = ("iban", "ssn", "passport", "account number", "account no", "acct", "national id", "tax id")
SECRET_CUES = ("password", "passwd", "token", "api_key", "apikey", "api key", "secret", "access_key")
_LOGIN = re.compile(r"([^\s/@:]+):([^\s/@]+)@[A-Za-z0-9.-]+")
_ACCOUNT = re.compile(r"(?:[\x20:#=.]|is|no|number){0,12}([A-Za-z0-9](?:[\x20-]?[A-Za-z0-9]){4,40})")
_DIGIT_GROUPS = re.compile(r"[0-9](?:[\x20-]?[0-9])*(?![A-Za-z])")
_TOKEN = re.compile(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*")
_IS = re.compile(r"[\x20\t]{0,3}(?:=|:)[\x20\t]{0,3}")
_SECRET = re.compile(r"([\"']?)([^\s\"']{8,}+)\1")
_DIGITS = frozenset("0123456789")


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in "0123456789":
        out.add_word(c, ("digit", 1))
    out.add_word("@", ("at", 1))
    out.add_word("+", ("plus", 1))
    for kind, cues in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                out.add_word(form, (kind, len(form)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def iban(value: str) -> bool:
    """The check digits of an international account number: the number made of its parts is 1 modulo 97."""
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _account(text: str, at: int, run: tuple[int, int]) -> tuple[tuple[int, int] | None, tuple[int, int]]:
    """The account after a cue: a sound IBAN, or else a token or group of digits with at least five digits, however long.

    ``run`` is the last token read, by its end and its fifth digit from behind: a cue inside it does not read it again.
    """
    if not (m := _ACCOUNT.match(text, at)):
        return None, run
    start, value = m.start(1), m.group(1)
    for end in sorted({len(value), *(k.start() for k in re.finditer(r"[\x20-]", value))}, reverse=True):
        if iban(value[:end].replace(" ", "").replace("-", "")):
            return (start, start + end), run
    if m := _DIGIT_GROUPS.match(text, start):
        return (m.span() if sum(c in _DIGITS for c in m.group()) >= 5 else None), run
    if start >= run[0]:
        token = _TOKEN.match(text, start)
        digits = [k for k in range(*token.span()) if text[k] in _DIGITS]
        run = token.end(), digits[-5] if len(digits) >= 5 else -1
    return ((start, run[0]) if start <= run[1] else None), run


_FOUND = None


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by kind as in KINDS, then by start; a kind's spans do not overlap."""
    global _FOUND
    if _FOUND is None:
        _FOUND = _automaton()
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    ip = card = email = phone = secret = run = 0  # where each kind goes on; run: where the run of digits at hand ends
    token = (0, -1)
    for end, (kind, length) in _FOUND.iter(text):
        at = end - length + 1
        if kind == "digit":
            if at == run and at:
                run += 1
                continue
            run = at + 1
            if at >= ip and (m := _IP.match(text, at)):
                ip = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                    out["ip"].append(m.span())
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif kind == "at":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out["email"].append((start, m.end()))
                email = m.end()
        elif kind == "plus":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c in _DIGITS for c in m.group()) <= 15:
                    out["phone"].append(m.span())
        elif kind == "scheme":
            if m := _LOGIN.match(text, end + 1):
                out["login"].append(m.span())
        elif not (text[at - 1:at].isalnum() if at else False):
            if kind == "account":
                found, token = _account(text, end + 1, token)
                if found:
                    out["account"].append(found)
            elif (m := _IS.match(text, end + 1)) and m.end() >= secret and (m := _SECRET.match(text, m.end())):
                out["secret"].append(m.span(2))  # a value that begins inside another ends with it
                secret = m.end(2)
    return [(k, a, b) for k in KINDS for a, b in (out[k] if k in BASE else merged(out[k]))]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first kind names the whole."""
    if not spans:
        return text
    out, at = [], 0
    for lo, hi in merged([(a, b) for _, a, b in spans]):
        kind = min((KINDS.index(k), k) for k, a, b in spans if lo <= a < hi)[1]
        out += [text[at:lo], f"[{kind}]"]
        at = hi
    return "".join(out) + text[at:]


def find_personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Personal data in whole texts, one row per input row: the id, ``spans`` (kind, start, end in code points) and,
    if wanted, ``redacted`` (the text with spans replaced by their kind; null stays null).

    A null text counts as empty and has no spans; repeated rows give repeated rows, no rows give none.
    """
    rows = pick(documents, id=id_col, text=text_col)
    kind = f"id {type_of(rows, 'id')}, spans array<struct<kind:string,start:int,end:int>>" + ", redacted string" * with_text
    spans_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for data in texts(batch.column(1)):
                text = data.decode("utf-8", "replace")
                found = find(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                if with_text:
                    clean.append(redacted(text, found))
            columns, names = [batch.column(0), pa.array(spans, spans_of)], ["id", "spans"]
            if with_text:
                nulls = batch.column(1).is_null().to_pylist()
                columns.append(pa.array([None if n else c for n, c in zip(nulls, clean)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def redact(documents: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data in the text replaced by its kind, and the length column set anew.

    Rows pass through one by one, whatever their other columns hold; a null text stays null and its length too.
    """
    names = documents.columns
    at, length = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nulls = batch.column(at).is_null().to_pylist()
            clean = []
            for data, null in zip(texts(batch.column(at)), nulls):
                text = data.decode("utf-8", "replace")
                clean.append(None if null else redacted(text, find(text)))
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            if length is not None:
                old = columns[length].to_pylist()
                columns[length] = pa.array([o if c is None else len(c) for o, c in zip(old, clean)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(lean(run), documents.schema)


def spans_text(spans: Column) -> Column:
    """The spans as ``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kinds(spans, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))

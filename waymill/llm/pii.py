"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in a text: at-signs, plus signs,
digits, URL schemes and identifier cues. From each anchor a parser expands to
the run of characters that its form can hold, so no match can cross the run's
borders, and reads the forms inside from the left: what it finds equals the
leftmost non-overlapping matches over the whole text.

Base kinds: email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone
(9 to 15 digits). Added kinds: iban (mod 97) and ssn (area, group and serial
not zero) after their cues, and login (user and password of a URL), where they overlap no base
span. Offsets are code points, ends exclusive.

Rows: null text counts as empty; missing or repeated doc_id pass through;
``redact`` keeps all columns, ``find_pii`` only doc_id. The time for a text grows
with its length (each form reads a stretch once), however long it is.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import balanced, steps, table
from .spans import SPAN, Span, Taken, as_arrow, digests, in_order

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "login")

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"
_MAIL = frozenset(_LETTERS + _DIGITS + "._%+-@")
_DOTTED = frozenset(_DIGITS + ".")
_SPACED = frozenset(_DIGITS + " -")
_DIALLED = frozenset(_DIGITS + " ().-")
_URL = frozenset(_LETTERS + _DIGITS + "._~%!$&*+=:@-")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[\s:#=-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"[\s:#=-]{0,4}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])")
_LOGIN = re.compile(r"([A-Za-z0-9._~%!$&*+=-]+:[A-Za-z0-9._~%!$&*+=-]+)@[A-Za-z0-9]")


@functools.lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in _DIGITS), *((w, "iban") for w in ("IBAN", "iban", "Iban")), *((w, "ssn") for w in ("SSN", "ssn", "Ssn"))]:
        found.add_word(word, kind)
    found.make_automaton()
    return found


def _run(text: str, at: int, allowed: frozenset, least: int) -> tuple[int, int]:
    """The run of allowed characters around position ``at``, not before ``least``."""
    s = e = at
    while s > least and text[s - 1] in allowed:
        s -= 1
    while e < len(text) and text[e] in allowed:
        e += 1
    return s, e


def _emails(text: str, start: int, stop: int) -> Iterator[Span]:
    """The addresses in a run of their characters. At each at-sign the name begins
    behind the at-sign or address before, and no later beginning can succeed
    where this one fails."""
    begin, at = start, text.find("@", start, stop)
    while at >= 0:
        after = at + 1
        if begin < at and (m := _DOMAIN.match(text, after, stop)):
            after = m.end()
            yield begin, after, "email"
        begin, at = after, text.find("@", after, stop)


def _ips(text: str, start: int, stop: int) -> Iterator[Span]:
    """Four numbers in a run of digits and dots with one dot between each two; a
    number that begins none is skipped as a whole."""
    numbers: list[tuple[int, int]] = []
    for m in _NUMBER.finditer(text, start, stop):
        if numbers and m.start() != numbers[-1][1] + 1:
            numbers.clear()
        numbers.append(m.span())
        if len(numbers) == 4:
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (text[a:b].lstrip("0") for a, b in numbers)):
                yield numbers[0][0], numbers[3][1], "ip"
            numbers.clear()


def luhn(number: str) -> bool:
    total = 0
    for i, d in enumerate(reversed([int(c) for c in number if c in _DIGITS])):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(number: str) -> bool:
    n = number.replace(" ", "")
    return 15 <= len(n) <= 34 and int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1


def find(text: str | None) -> list[Span]:
    """All spans of a text, in order."""
    if not text:
        return []
    base: list[Span] = []
    more: list[Span] = []
    to = dict.fromkeys(("mail", "dotted", "spaced", "dialled"), 0)  # how far each form has been read
    for last, kind in _anchors().iter(text):
        if kind == "digit":
            if last >= to["dotted"]:
                s, e = _run(text, last, _DOTTED, to["dotted"])
                to["dotted"] = e
                if text.count(".", s, e) >= 3:
                    base += _ips(text, s, e)
            if last >= to["spaced"]:
                s, e = _run(text, last, _SPACED, to["spaced"])
                to["spaced"] = e
                if e - s >= 12:
                    base += [(m.start(), m.end(), "card") for m in _CARD.finditer(text, s, e) if 12 <= sum(c in _DIGITS for c in m[0]) <= 19 and luhn(m[0])]
        elif kind == "at":
            if last >= to["mail"]:
                s, e = _run(text, last, _MAIL, to["mail"])
                to["mail"] = e
                base += _emails(text, s, e)
        elif kind == "plus":
            if last >= to["dialled"]:
                e = last + 1
                while e < len(text) and (text[e] in _DIALLED):
                    e += 1
                if m := _PHONE.match(text, last, e):
                    to["dialled"] = m.end()
                    if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                        base.append((last, m.end(), "phone"))
        elif kind == "scheme":
            e = last + 1
            while e < len(text) and text[e] in _URL:
                e += 1
            if m := _LOGIN.match(text, last + 1, e):
                more.append((m.start(1), m.end(1), "login"))
        elif m := (_IBAN if kind == "iban" else _SSN).match(text, last + 1):
            if kind == "ssn" or iban_ok(m[1]):
                more.append((m.start(1), m.end(1), kind))
    taken = Taken(base)
    return in_order(base + [x for x in more if taken.free(x[0], x[1])], KINDS)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), as_arrow([find(t) for t in b.column("text").to_pylist()])], names=["doc_id", "spans"])

    return balanced(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, f"doc_id long, spans {SPAN}")


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become
    one mark of the first."""
    if not (spans := find(text)):
        return text
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the personal data of ``text_col`` replaced and
    n_chars, where present, counted anew."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text_col):
            old = b.column(text_col).to_pylist()
            new = [redacted(t) for t in old]
            b = b.set_column(names.index(text_col), b.schema.field(text_col), pa.array(new, b.schema.field(text_col).type))
            if "n_chars" in names:
                size = [n if a == t else len(t) for n, a, t in zip(b.column("n_chars").to_pylist(), old, new)]
                b = b.set_column(names.index("n_chars"), b.schema.field("n_chars"), pa.array(size, b.schema.field("n_chars").type))
            yield b

    return balanced(docs).mapInArrow(run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_pii(table(spark, sf_dir, "documents")), BASE)

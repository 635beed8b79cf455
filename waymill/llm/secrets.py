"""Secret scans with inferred format grammars.

Base kinds, leftmost non-overlapping over the whole text: assign (a credential
name, a sign and a value of 6 or more characters; the span is the whole match),
access (AKIA keys of 20 or more characters) and hex (runs of 24 or more).

Further kinds come from probabilistic automata. The labelled credentials of a
format become a prefix tree; states whose next-symbol and end frequencies are
statistically compatible (Hoeffding bound, recursively) are merged, in the
red-blue order of state-merging inference, and the frequencies are smoothed. A
symbol is the character itself in a format's literal lead (the first positions,
LEAD at most, that show few characters), and its class (upper, lower, digit, or
the sign itself) after that.

A candidate begins wherever a format's lead does, inside a longer run too
(``key=...``, ``/path/...``); an Aho-Corasick automaton finds the leads. Its
likelihood under the format against that under ordinary identifiers (BACKGROUND)
is summed symbol by symbol to the last one that the format can have (signs at
the end left out). It is reported if the sum, with the end's likelihood, reaches
the least of the labelled ones, so there is no length window: long tokens have
more evidence. It must overlap no
base span; of overlapping candidates the leftmost stays, then the likelier.

The labelled credentials are made by rule from published formats, with a fixed
seed; none is a real one.

Rows: null text counts as empty; missing or repeated doc_id pass through; other
columns are ignored. Offsets are code points, ends exclusive. A text of any length
is read once; a candidate ends at its best sum where it falls GIVE_UP below.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import balanced, steps, table
from .spans import SPAN, Span, Taken, as_arrow, digests

BASE = ("assign", "access", "hex")
LEAD = 4
#: Labelled credentials of each format, and the merge test's error bound.
SAMPLES, ALPHA = 250, 0.01
#: Lead positions show at most so many characters; the weight of unseen symbols; nats below the best at which reading ends.
FEW, UNSEEN, GIVE_UP = 8, 0.2, 30.0
#: Shares of symbols in ordinary identifiers and paths; other signs share the rest.
BACKGROUND = {"lower": 0.7, "upper": 0.08, "digit": 0.08}
_SIGNS = "+/_.=-"

_ASSIGN = re.compile(r"""(?a)(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_ALNUM = string.ascii_letters + string.digits
_URLSAFE = _ALNUM + "-_"


def _assign_spans(text: str) -> list[Span]:
    """Each match holds one separator that decides it, so the text is searched
    for separators only and the name is read backwards from there."""
    signs, out, end = [], [], 0
    for sign in ":=":
        at = text.find(sign)
        while at >= 0:
            signs.append(at)
            at = text.find(sign, at + 1)
    for at in sorted(signs):
        i = at
        while i > end and text[i - 1] == " ":
            i -= 1
        if i > end and text[i - 1] in "\"'":
            i -= 1
        tail = text[max(end, i - 8) : i].lower()
        for name in _NAMES:
            if tail.endswith(name) and i - len(name) >= end and (m := _ASSIGN.match(text, i - len(name))):
                end = m.end()
                if len(m[2]) >= 6:
                    out.append((m.start(), m.end(), "assign"))
                break
    return out


def base_spans(text: str) -> list[Span]:
    return [
        *_assign_spans(text),
        *((m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20),
        *((m.start(), m.end(), "hex") for m in _HEX.finditer(text)),
    ]


def labelled(samples: int = SAMPLES, seed: int = 11) -> dict[str, list[str]]:
    """Made-up credentials of published formats."""
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    made = {
        "github": lambda: rng.choice(["ghp_", "gho_", "ghs_", "ghu_"]) + pick(_ALNUM, 36),
        "gitlab": lambda: "glpat-" + pick(_URLSAFE, 20),
        "google": lambda: "AIza" + pick(_URLSAFE, 35),
        "jwt": lambda: "eyJ" + pick(_URLSAFE, rng.randint(17, 40)) + ".eyJ" + pick(_URLSAFE, rng.randint(20, 160)) + "." + pick(_URLSAFE, rng.choice([43, 86, 342])),
        "npm": lambda: "npm_" + pick(_ALNUM, 36),
        "slack": lambda: rng.choice(["xoxb-", "xoxp-"]) + pick(string.digits, rng.randint(10, 13)) + "-" + pick(string.digits, rng.randint(10, 13)) + "-" + pick(_ALNUM, 24),
        "stripe": lambda: rng.choice(["sk_live_", "rk_live_", "sk_test_"]) + pick(_ALNUM, 24),
    }
    return {kind: [make() for _ in range(samples)] for kind, make in made.items()}


def _class(c: str) -> str:
    return "upper" if "A" <= c <= "Z" else "lower" if "a" <= c <= "z" else "digit" if "0" <= c <= "9" else c


def symbols(text: str, lead: int) -> list[str]:
    return [*text[:lead], *map(_class, text[lead:])]


def _background(symbol: str) -> float:
    """Log-likelihood of a symbol in ordinary text; of a literal, as one of its class."""
    if symbol in BACKGROUND:
        return math.log(BACKGROUND[symbol])
    kind = _class(symbol)
    if kind in BACKGROUND:
        return math.log(BACKGROUND[kind] / (10 if kind == "digit" else 26))
    return math.log((1 - sum(BACKGROUND.values())) / len(_SIGNS))


class Automaton:
    """A probabilistic automaton: next states, and in each the log-likelihood of
    symbols against ordinary text and that of the end."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        at = [{x[i : i + 1] for x in examples} for i in range(LEAD)]
        self.lead = next((i for i, found in enumerate(at) if len(found) > FEW), LEAD)
        self.leads = sorted({x[: self.lead] for x in examples})
        go, count, end = self._tree([symbols(x, self.lead) for x in examples])
        self._merge(go, count, end, alpha)
        self.least = min(self.best(x, 0)[0] for x in examples) - 1e-9

    @staticmethod
    def _tree(words: list[list[str]]):
        go: list[dict[str, int]] = [{}]
        count: list[Counter] = [Counter()]
        end = [0]
        for w in words:
            s = 0
            for x in w:
                count[s][x] += 1
                if x not in go[s]:
                    go[s][x] = len(go)
                    go.append({})
                    count.append(Counter())
                    end.append(0)
                s = go[s][x]
            end[s] += 1
        return go, count, end

    def _merge(self, go, count, end, alpha: float) -> None:
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        total = lambda s: sum(count[s].values()) + end[s]

        def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
            return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

        def compatible(a: int, b: int) -> bool:
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                na, nb = total(a), total(b)
                if differ(end[a], na, end[b], nb) or any(differ(count[a][x], na, count[b][x], nb) for x in {*count[a], *count[b]}):
                    return False
                todo += [(go[a][x], go[b][x]) for x in go[a] if x in go[b] and go[a][x] != go[b][x]]
            return True

        def fold(a: int, b: int) -> None:
            """Adds the subtree b to state a."""
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                end[a] += end[b]
                count[a].update(count[b])
                for x, t in list(go[b].items()):
                    if x in go[a]:
                        if go[a][x] != t:
                            todo.append((go[a][x], t))
                    else:
                        go[a][x] = t

        red = [0]
        while True:
            blue = [(s, x, t) for s in red for x, t in sorted(go[s].items()) if t not in red]
            if not blue:
                break
            s, x, t = blue[0]
            # the literal beginning is a format's mark: its states stay apart
            like = next((r for r in red if min(self._depth(go, r), self._depth(go, t)) >= self.lead and compatible(r, t)), None)
            if like is None:
                red.append(t)
            else:
                go[s][x] = like
                fold(like, t)
        index = {s: i for i, s in enumerate(red)}
        self.next = [{x: index[t] for x, t in go[s].items()} for s in red]
        known = sorted({x for s in red for x in count[s]})
        # a symbol that a state has not seen leads where it most often does, if the format has it at all
        common: dict[str, Counter] = {x: Counter() for x in known}
        for s in red:
            if self._depth(go, s) >= self.lead:
                for x, n in count[s].items():
                    common[x][index[go[s][x]]] += n
        weight = lambda s: total(s) + UNSEEN * (len(known) + 1)
        self.gain = [{x: math.log(n / weight(s)) - _background(x) for x, n in ((x, count[s][x] + UNSEEN) for x in known)} for s in red]
        self.stop = [math.log((end[s] + UNSEEN) / weight(s)) for s in red]
        for i, s in enumerate(red):
            if self._depth(go, s) >= self.lead:
                for x in known:
                    if common[x]:
                        self.next[i].setdefault(x, common[x].most_common(1)[0][0])

    def _depth(self, go, s: int) -> int:
        """Steps from the start, up to the lead's."""
        layer = {0}
        for d in range(self.lead):
            if s in layer:
                return d
            layer = {t for r in layer for t in go[r].values()}
        return self.lead

    def best(self, text: str, at: int) -> tuple[float, int]:
        """The log-likelihood against ordinary text of the candidate that begins
        at ``at``, and where it ends; minus infinity if nothing does."""
        s, total, top, end, i = 0, 0.0, (-math.inf, at), None, at
        while i < len(text):
            x = text[i] if i - at < self.lead else _class(text[i])
            to = self.next[s].get(x)
            if to is None:
                break
            total += self.gain[s][x]
            s, i = to, i + 1
            if i - at >= self.lead:
                if x not in "._=-":  # signs at the end are the sentence's
                    end = (total + self.stop[s], i)
                    top = max(top, end)
                if total + self.stop[s] < top[0] - GIVE_UP:
                    return top
        return end or top

    def accepts(self, text: str) -> bool:
        score, stop = self.best(text, 0)
        return stop == len(text) and score >= self.least


@functools.lru_cache(maxsize=1)
def grammars() -> dict[str, Automaton]:
    return {kind: Automaton(examples) for kind, examples in labelled().items()}


def leads(formats: dict[str, Automaton]) -> ahocorasick.Automaton | None:
    """Finds every format's leads; None without formats."""
    found: dict[str, list[str]] = {}
    for kind, a in sorted(formats.items()):
        for word in a.leads:
            found.setdefault(word, []).append(kind)
    out = ahocorasick.Automaton()
    for word, kinds in found.items():
        out.add_word(word, (len(word), kinds))
    out.make_automaton()
    return out if found else None


def find(text: str | None, formats: dict[str, Automaton], anchors: ahocorasick.Automaton | None = None) -> list[Span]:
    if not text:
        return []
    base = base_spans(text)
    anchors = anchors or leads(formats)
    more: list[Span] = []
    if anchors is not None:
        taken, end = Taken(base), 0
        starts = sorted({(last - n + 1, k) for last, (n, kinds) in anchors.iter(text) for k in kinds})
        at = 0
        while at < len(starts):
            first, found = starts[at][0], []
            while at < len(starts) and starts[at][0] == first:
                kind = starts[at][1]
                at += 1
                if first >= end:
                    score, stop = formats[kind].best(text, first)
                    if score >= formats[kind].least and taken.free(first, stop):
                        found.append((score, stop, kind))
            if found:
                _, end, kind = max(found)
                more.append((first, end, kind))
    kinds = [*BASE, *sorted(formats)]
    return sorted(base + more, key=lambda x: (x[0], kinds.index(x[2]), x[1]))


def find_secrets(docs: DataFrame, formats: dict[str, Automaton] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(formats or grammars())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = leads(shared.value)
        for b in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), as_arrow([find(t, shared.value, anchors) for t in b.column("text").to_pylist()])], names=["doc_id", "spans"])

    return balanced(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, f"doc_id long, spans {SPAN}")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_secrets(table(spark, sf_dir, "documents")), BASE)

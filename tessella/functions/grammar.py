"""Heuristic grammar of proof scripts: sentences, their kinds, and proofs.

Comments nest and strings hide periods, so the splitter is a scanner in Python; classification is
regular and also comes as Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Keywords that decide a sentence's kind.
PROOF_ENDERS = ["Qed.", "Save", "Defined", "Admitted.", "Abort", "Solve All Obligations", "Solve Obligations", "Proof (?!with|using)"]
PROOF_NON_STARTERS = ["Obligation Tactic", "Obligations"]
PROOF_STARTERS = ["Proof", "Next Obligation", r"Obligation \d+", "Final Obligation"]
PROGRAM_STARTERS = ["Program", r"#\[.*program.*\]"]
THEOREM_STARTERS = [
    "Goal", "Theorem", "Lemma", "Fact", "Remark", "Corollary", "Proposition", "Property", "Definition", "Example",
    "Instance", "Let", "Add Morphism", "Add Setoid", "Declare Morphism", "Add Parametric Morphism", "Function",
    "Fixpoint", "Coercion",
]
QUERIES = ["About", "Check", "Search", "Print", "Locate"]
CONTROLLERS = ["Time", "Redirect", "Fail", "Succeed", "Timeout"]
ATTRIBUTES = ["Global", "Local", "Polymorphic", "Monomorphic", "Cumulative", "NonCumulative", "Private", "Program"]
REQUIREMENT = r"^(?:From\s+(\S+)\s+)?Require\s+(?:Import\s+|Export\s+)?(.*?)\.?$"


def _start(words: list[str]) -> str:
    return "^(?:" + "|".join(w if w[-1] in ".)" else w + r"\b" for w in words) + ")"


_PREFIX = r"^(?:#\[[^\]]*\]\s*|(?:" + "|".join(ATTRIBUTES[:-1] + CONTROLLERS) + r")\s+)+"


@dataclass(frozen=True)
class Sentence:
    idx: int
    text: str
    start: int
    end: int


def mask(text: str, fill: str = "\x00") -> str:
    """Text of the same length in which comments (nested) are blank and strings are filled; ``""`` is a quote in a string."""
    if '"' not in text and "(*" not in text:
        return text
    out, i, n, depth, quoted = [], 0, len(text), 0, False
    while i < n:
        two = text[i : i + 2]
        if quoted:
            if two == '""':
                out.append("  " if depth else fill * 2)
                i += 2
                continue
            quoted = text[i] != '"'
            out.append(" " if depth else fill if quoted else '"')
        elif two == "(*" and text[i : i + 3] != "(*)":
            depth += 1
            out.append("  ")
            i += 2
            continue
        elif depth and two == "*)":
            depth -= 1
            out.append("  ")
            i += 2
            continue
        elif text[i] == '"':
            quoted = True
            out.append(" " if depth else '"')
        else:
            out.append(" " if depth and text[i] != "\n" else text[i])
        i += 1
    return "".join(out)


def strip_comments(text: str) -> str:
    """Text without comments; strings are left alone."""
    hidden = mask(text)
    return "".join(c if m == "\x00" else m for c, m in zip(text, hidden, strict=True))


def comments(text: str) -> Iterator[tuple[str, int, int]]:
    """Outermost comments with their bounds."""
    depth, i, begun, quoted = 0, 0, 0, False
    while i < len(text):
        two = text[i : i + 2]
        if text[i] == '"':
            quoted = not quoted
        elif not quoted and two == "(*" and text[i : i + 3] != "(*)":
            begun = begun if depth else i
            depth += 1
            i += 1
        elif not quoted and depth and two == "*)":
            depth -= 1
            i += 1
            if not depth:
                yield text[begun : i + 1], begun, i + 1
        i += 1


_BULLET = re.compile(r"\s*([-+*]+(?=\s|$)|[{}]|\d+\s*:\s*\{)")
_PERIOD = re.compile(r"\.(?=\s|$)")


def split_sentences(text: str) -> Iterator[Sentence]:
    """Sentences with their bounds: a period before white space ends one; bullets and braces stand alone."""
    hidden = mask(text)
    idx, at = 0, 0

    def made(lo: int, hi: int) -> Sentence | None:
        raw = "".join(text[k] if hidden[k] == "\x00" else hidden[k] for k in range(lo, hi))
        clean = " ".join(raw.split())
        if not clean or clean == ".":
            return None
        lead = len(raw) - len(raw.lstrip())
        return Sentence(idx, clean, lo + lead, lo + len(raw.rstrip()))

    while at < len(hidden):
        b = _BULLET.match(hidden, at)
        if b:
            if s := made(b.start(1), b.end(1)):
                yield s
                idx += 1
            at = b.end()
            continue
        end = _PERIOD.search(hidden, at)
        hi = end.end() if end else len(hidden)
        if s := made(at, hi):
            yield s
            idx += 1
        at = hi


def bare(sentence: str) -> str:
    """Sentence without attributes and control commands before it."""
    return re.sub(_PREFIX, "", sentence)


def kind(sentence: str) -> str:
    """Kind of a sentence; the first that fits."""
    s = bare(sentence)
    for name, pattern in KINDS:
        if re.search(pattern, s):
            return name
    return "other"


TACTIC = r"^(?:[a-z][\w']*\b|all\s*:|\d+\s*:|\[|\()"
KINDS = [
    ("bullet", r"^(?:[-+*]+|[{}]|\d+\s*:\s*\{)$"),
    ("requirement", r"^(?:From\s+\S+\s+)?Require\b"),
    ("query", _start(QUERIES)),
    ("proof_ender", _start(PROOF_ENDERS)),
    ("proof_starter", "(?!" + _start(PROOF_NON_STARTERS) + ")" + _start(PROOF_STARTERS)),
    ("program", _start(PROGRAM_STARTERS)),
    ("theorem", _start(THEOREM_STARTERS)),
    ("tactic_definer", r"^Ltac\b"),
    ("tactic", TACTIC),
]


def kind_column(sentence: Column) -> Column:
    """``kind`` as a Column, in the same order."""
    s = F.regexp_replace(sentence, _PREFIX, "")
    out = F.when(s.rlike(KINDS[0][1]), KINDS[0][0])
    for name, pattern in KINDS[1:]:
        out = out.when(s.rlike(pattern), name)
    return out.otherwise("other")


def identifier(sentence: Column) -> Column:
    """Name that a theorem-like sentence declares."""
    words = "|".join(THEOREM_STARTERS)
    found = F.regexp_extract(F.regexp_replace(sentence, _PREFIX, ""), rf"^(?:Program\s+)?(?:{words})\s+([\w'.]+)", 1)
    return F.nullif(found, F.lit(""))


def requirements(sentence: Column) -> Column:
    """Libraries that a requirement names, with the prefix of ``From``."""
    prefix = F.regexp_extract(sentence, REQUIREMENT, 1)
    names = F.filter(F.split(F.regexp_replace(F.regexp_extract(sentence, REQUIREMENT, 2), r"\.$", ""), r"\s+"), lambda n: n != "")
    return F.transform(names, lambda n: F.when(prefix != "", F.concat(prefix, F.lit("."), n)).otherwise(n))


def proof_mask(kinds: list[str]) -> list[bool]:
    """Which sentences belong to a proof: from a starter (or a first tactic) to its ender; found from the back."""
    out, open_ = [False] * len(kinds), False
    for i in range(len(kinds) - 1, -1, -1):
        if kinds[i] == "proof_ender":
            open_ = True
        out[i] = open_
        if open_ and kinds[i] in ("theorem", "program"):
            out[i], open_ = False, False
    return out


def glom_proofs(sentences: list[str]) -> list[str]:
    """Sentences with each proof put together into one."""
    inside = proof_mask([kind(s) for s in sentences])
    out: list[str] = []
    for i, s in enumerate(sentences):
        if inside[i] and i and inside[i - 1]:
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def glom_runs(sentences: list[str], name: str = "tactic_definer") -> list[str]:
    """Sentences with runs of one kind put together."""
    out, last = [], None
    for s in sentences:
        k = kind(s)
        if k == name and last == name:
            out[-1] += " " + s
        else:
            out.append(s)
        last = k
    return out


def statistics(sentences: list[str]) -> dict[str, int]:
    """Counts of kinds, and the deepest nesting of open proofs."""
    out: dict[str, int] = {"sentences": len(sentences), "max_depth": 0}
    depth = 0
    for s in sentences:
        k = kind(s)
        out[k] = out.get(k, 0) + 1
        depth += (k == "theorem") - (k == "proof_ender")
        out["max_depth"] = max(out["max_depth"], depth)
    return out


@udtf(returnType="idx int, sentence string, start int, end int, kind string", useArrow=True)
class SplitSentences:
    """Table function: sentences of a text."""

    def eval(self, text: str) -> Iterator[tuple]:
        for s in split_sentences(text or ""):
            yield s.idx, s.text, s.start, s.end, kind(s.text)


def sentences_of(df: DataFrame, text: str) -> DataFrame:
    """Rows with each of their text's sentences."""
    spark = df.sparkSession
    spark.udtf.register("split_sentences", SplitSentences)
    return spark.sql(f"SELECT s.*, p.* FROM {{df}} s, LATERAL split_sentences(s.`{text}`) p", df=df)

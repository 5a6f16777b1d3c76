"""License scan: Aho-Corasick over identifier tags and notice phrases, and a
shunting-yard parser for the and/or/with expressions behind the tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The phrases of the base, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and labels.
PHRASES = {
    "apache license": "apache", "apache license version 2 0": "apache-2.0", "mit license": "mit",
    "bsd license": "bsd", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "general public license version 2": "gpl-2.0", "general public license version 3": "gpl-3.0",
    "creative commons": "cc", "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0", "public domain": "public-domain",
}
#: Tags in front of a license expression.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Identifiers that ``permitted`` accepts.
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "unlicense", "zlib"})
#: Identifiers and exceptions of the public license list that tags may name
#: (``evaluate`` takes others), besides references that begin with ``licenseref-``.
IDENTIFIERS = frozenset("""
0bsd afl-2.1 afl-3.0 agpl-1.0 agpl-1.0-only agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0
apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause
bsd-3-clause-clear bsd-4-clause bsd-source-code bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0
cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0
cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cpal-1.0
cpl-1.0 ecl-2.0 efl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-1.0-only
gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu ijg ipl-1.0 isc
lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only
lgpl-3.0-or-later libpng lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0
ncsa odbl-1.0 odc-by-1.0 ofl-1.1 openssl osl-2.1 osl-3.0 pddl-1.0 php-3.01 postgresql python-2.0 qpl-1.0 ruby sgi-b-2.0
sissl sleepycat spl-1.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split())
EXCEPTIONS = frozenset("""
389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception
classpath-exception-2.0 ecos-exception-2.0 font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1
gpl-3.0-linking-exception linux-syscall-note llvm-exception openvpn-openssl-exception qt-gpl-exception-1.0
u-boot-exception-2.0 wxwindows-exception-3.1
""".split())
#: Evidence of a valid tag and of one notice label.
TAG_WEIGHT, NOTICE_WEIGHT = 0.9, 0.6

_SEPARATORS = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TOKEN = re.compile(r"\(|\)|[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?")
#: What an expression may consist of; anything else ends it, as a comma or a comment's end.
_EXPRESSION = re.compile(r"[ \t()a-z0-9.+-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression in postfix order, or None if it is not well formed.

    ``with`` binds tighter than ``and``, ``and`` tighter than ``or``.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether the last token ended an operand
    for token in _TOKEN.findall(expression):
        if token in _RANK:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or not operand:
                return None
            stack.pop()
        else:
            if operand:
                return None
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(rpn: list[str], allowed: frozenset[str] = PERMISSIVE,
             names: frozenset[str] | None = None) -> tuple[bool, list[str]] | None:
    """Whether the expression can be met with ``allowed`` licenses, and the licenses it
    names; ``x with y`` stands and falls with x. None if an operand is missing or,
    where ``names`` are given, is neither one of them nor, behind ``with``, an exception."""
    stack: list[tuple[bool, list[str]]] = []
    for at, token in enumerate(rpn):
        if token not in _RANK:
            plain = token.rstrip("+")
            known = names is None or plain in names or token.startswith("licenseref-")
            if not known and not (token in EXCEPTIONS and rpn[at + 1 : at + 2] == ["with"]):
                return None
            stack.append((plain in allowed, [token]))
            continue
        if len(stack) < 2:
            return None
        (b, b_names), (a, a_names) = stack.pop(), stack.pop()
        if token == "with":
            if len(a_names) != 1 or len(b_names) != 1 or (names is not None and b_names[0] not in EXCEPTIONS):
                return None
            stack.append((a, a_names))
        else:
            stack.append((a and b if token == "and" else a or b, a_names + b_names))
    return stack[0] if len(stack) == 1 else None


def _automaton(patterns: dict[str, tuple]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        machine.add_word(pattern, value)
    machine.make_automaton()
    return machine


class Scanner:
    """Both automata; built once per Python task."""

    def __init__(self) -> None:
        known = {f" {p} ": (len(p) + 2, label, False) for p, label in PHRASES.items()}
        known |= {f" {p} ": (len(p) + 2, label, True) for p, label in BASE_PHRASES.items()}
        self.phrases = _automaton(known)
        self.tags = _automaton({t: (t,) for t in TAGS})

    def scan(self, text: str | None) -> dict:
        low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        words = _SEPARATORS.sub(" ", low).strip(" ")
        n_words = words.count(" ") + 1 if words else 0
        words = f" {words} "
        base_labels, labels, places = set(), set(), []
        at = counted = 0  # words before character ``at``
        for end, (size, label, base) in self.phrases.iter(words):
            labels.add(label)
            if base:
                base_labels.add(label)
                places.append(end + 1 - size)
        places.sort()
        index = []
        for p in places:
            counted += words.count(" ", at, p)
            at = p
            index.append(counted)
        verdicts, tagged, expressions = [], set(), []
        tags = [(end + 1 - len(tag), end + 1) for end, (tag,) in self.tags.iter(low)]
        stops = [*[start for start, _ in tags[1:]], len(low)]
        for (_, begin), stop in zip(tags, stops, strict=False):
            rpn = postfix(_EXPRESSION.match(low, begin, stop)[0])
            found = evaluate(rpn, names=IDENTIFIERS) if rpn else None
            if found:
                verdicts.append(found[0])
                tagged.update(found[1])
                expressions.append(" ".join(rpn))
        notices = len(labels)
        score = 1 - (1 - TAG_WEIGHT) ** min(len(verdicts), 4) * (1 - NOTICE_WEIGHT) ** min(notices, 8)
        return {
            "n_words": n_words, "n_base": len(index), "first_word": index[0] if index else None,
            "last_word": index[-1] if index else None, "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(labels | tagged)), "score": score,
            "expressions": expressions, "permitted": all(verdicts) if verdicts else None,
        }


FIELDS = [
    ("n_words", T.LongType(), pa.int64()), ("n_base", T.LongType(), pa.int64()),
    ("first_word", T.LongType(), pa.int64()), ("last_word", T.LongType(), pa.int64()),
    ("base_labels", T.StringType(), pa.string()), ("labels", T.StringType(), pa.string()),
    ("score", T.DoubleType(), pa.float64()), ("expressions", T.ArrayType(T.StringType()), pa.list_(pa.string())),
    ("permitted", T.BooleanType(), pa.bool_()),
]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id (null stays null) and what the scan found.

    ``first_word`` and ``last_word`` are null without a base phrase; ``labels`` holds the
    labels of all phrases and the licenses of well-formed tags (names of the license list,
    combined by and, or, with; a tag ends where something else begins); ``expressions`` are these
    in postfix order, ``permitted`` whether all can be met by permissive licenses (null
    without one). Null and empty texts give zeros and empty labels. Other columns of
    ``docs`` are not read, so their names cannot clash.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, t) for n, t, _ in FIELDS]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[n] for r in found], t) for n, _, t in FIELDS]],
                names=["doc_id", *[n for n, _, _ in FIELDS]])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(scan, schema)

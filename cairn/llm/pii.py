"""Personal data: base patterns, and spans that boosted trees choose from high-recall candidates.

The trees learn from the documents themselves: from the candidates in all of them, labelled by rules that abstain where they can't
tell, and from unusual forms and look-alikes written into their texts. Thresholds are calibrated on documents that no tree has seen.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, materialize, release, slices

#: Kinds of spans; the first four have base patterns, the last only added spans.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match from the middle of a run of digits is one from its start too, so that starts within a run are not tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Candidates beyond the base patterns; they may overlap. A span is the pattern's group, or the whole match if it has none. A text of which the last
#: function says no has no match of the pattern, and is not searched.
DIGIT = re.compile(r"[0-9]").search
AT = re.compile(r"(?:@|[\[({<]\s?(?:at|AT)\s?[\])}>]|\s(?:at|AT)\s)\s{0,2}[A-Za-z0-9-]{1,63}\s{0,2}(?:\.|[\[({<]\s?(?:dot|DOT)\s?[\])}>]|\s(?:dot|DOT)\s)").search
#: What (?i) takes for i and s beside their capitals, and lower() does not turn into them.
ODD = re.compile("[İıſ]").search


def _keyed(text: str) -> bool:
    low = text.lower()
    return any(word in low for word in ("passw", "pwd", "secret", "token", "key", "pin")) or (not text.isascii() and ODD(text) is not None)


GENERATORS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s{0,2}(?:@|[\[({<]\s?(?:at|AT)\s?[\])}>]|\s(?:at|AT)\s)\s{0,2}[A-Za-z0-9-]{1,63}(?:\s{0,2}(?:\.|[\[({<]\s?(?:dot|DOT)\s?[\])}>]|\s(?:dot|DOT)\s)\s{0,2}[A-Za-z0-9-]{1,63}){1,4}"), AT),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), re.compile(":").search),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s\.\s|\.)[0-9]{1,3}){3}(?![0-9])"), DIGIT),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./_ -]{0,3}[0-9]{2,6}){2,5}(?![0-9])"), DIGIT),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?[(]?[0-9]{1,4}[)]?(?:[\s./()-]{1,2}[0-9]{2,4}){2,5}(?![0-9A-Za-z])"), DIGIT),
    # A token of any length, with a letter and a digit; parts with dots between them are one.
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/=.@-])(?=[A-Za-z_+/.-]*[0-9])(?=[0-9_+/.-]*[A-Za-z])[A-Za-z0-9_+/-]{16,}(?:\.[A-Za-z0-9_+/-]+)*={0,2}(?![A-Za-z0-9_+/=@])"), DIGIT),
    ("secret", re.compile(r"(?i)(?:passw(?:or)?d|pwd|secret|token|key|pin)['\"]?\s{0,2}(?:[:=]|\bis\b)\s{0,2}['\"]?([^\s'\",;]{6,})"), _keyed),
    # A key in a frame of its own.
    ("secret", re.compile(r"-----BEGIN [A-Z0-9 ]{1,40}-----(?:(?!-----BEGIN|-----END).)*-----END [A-Z0-9 ]{1,40}-----", re.DOTALL), re.compile("-----BEGIN ").search),
)
CUES = {
    "email": re.compile(r"(?i)e-?mail|contact|write|reach|courriel|correo"),
    "ip": re.compile(r"(?i)\bip\b|host|server|address|connect|login"),
    "card": re.compile(r"(?i)card|visa|master|amex|pay|credit|carte|karte|tarjeta"),
    "phone": re.compile(r"(?i)phone|\btel|call|fax|mobile|whats|t[ée]l[ée]f|handy"),
    "secret": re.compile(r"(?i)token|key|secret|passw|pwd|auth|bearer|credential"),
}
AGAINST = re.compile(r"(?i)version|\bv\.?$|order|invoice|isbn|serial|\bid\b|\bno\b|ref|page|figure|section|total|sum|date|table")
HEX = frozenset("0123456789abcdefABCDEF")
TOP_LEVEL = frozenset("com org net edu gov info io de fr es uk us eu ch at".split())
#: Characters before and after a span that are its context.
AROUND = 32
#: Examples of a partition that the trees are fitted on, and steps of probability that thresholds are told apart by.
FIT_ROWS, CELLS = 250_000, 1 << 16
NO_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return NO_DIGITS.sub("", text)


def _octets(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping within a kind; matches that fail their check are dropped."""
    found: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _octets(m.group())]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all candidates of all generators."""
    found = set()
    for kind, pattern, needs in GENERATORS:
        if needs(text):
            group = pattern.groups
            found |= {(m.start(group), KINDS.index(kind), m.end(group)) for m in pattern.finditer(text)}
    return sorted(found)


NAMES = ("k0", "k1", "k2", "k3", "k4", "length", "digits", "share", "groups", "luhn", "octets", "plus", "parens", "top", "words", "cue", "against", "before", "after", "spaces", "even", "marks", "short", "zeros", "distinct", "entropy", "hex", "upper", "quoted", "given")


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """The format of a span, and its context of AROUND characters on either side, as numbers in the order of NAMES."""
    start, kind, end = span
    s = text[start:end]
    left, right = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    digits, groups = _digits(s), re.findall(r"[0-9]+", s)
    last = re.split(r"[^A-Za-z0-9-]+", s)[-1].lower()
    often = {c: s.count(c) for c in set(s)}
    shares, many = [n / len(s) for n in often.values()], lambda which: sum(n for c, n in often.items() if which(c))
    return [
        *[float(kind == k) for k in range(len(KINDS))], float(len(s)), float(len(digits)), len(digits) / len(s), float(len(groups)), float(bool(digits) and luhn(digits)),
        float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)), float(s[0] == "+" or (kind == KINDS.index("phone") and s[:2] == "00")), float("(" in s), float(last in TOP_LEVEL),
        float(len(re.findall(r"\b(?:at|dot|AT|DOT)\b", s))), float(bool(CUES[KINDS[kind]].search(left) or CUES[KINDS[kind]].search(right))), float(bool(AGAINST.search(left))),
        float(left[-1:].isalnum()), float(right[:1].isalnum()), float(many(str.isspace)), float(len({len(g) for g in groups}) == 1 and len(groups) > 1),
        float(len(s) - many(str.isalnum) - many(str.isspace)), float(min(map(len, groups), default=0)), float(digits.count("0")), float(len(set(digits))),
        -sum(x * math.log2(x) for x in shares), float(often.keys() <= HEX), many(str.isupper) / len(s), float(left[-1:] in "\"'" and left != ""), float(bool(re.search(r"[:=]\s{0,2}[\"']?$", left))),
    ]


def weak_label(text: str, span: tuple[int, int, int], base: set[tuple[int, int, int]]) -> float | None:
    """What rules tell of a candidate in a document: 1 it is personal data or a secret, 0 it is not, None they can't tell."""
    start, kind, end = span
    if span in base:
        return 1.0
    if any(start < b[2] and b[0] < end for b in base):
        return None
    s, left = text[start:end], text[max(0, start - AROUND) : start]
    digits, cue = _digits(s), bool(CUES[KINDS[kind]].search(left))
    if kind < KINDS.index("secret") and (left[-1:].isalnum() or text[end : end + 1].isalnum()):
        return 0.0
    if kind == 0:
        named = re.split(r"[^A-Za-z0-9-]+", s)[-1].lower() in TOP_LEVEL and len(re.findall(r"[.]|dot", s, re.IGNORECASE)) > 0
        return 1.0 if named and re.search(r"@|[\[({<]|dot|DOT", s) else 0.0
    if kind == 1:
        return float(s.count(":") == 7 or _octets(re.sub(r"[^0-9.]", "", s)) and "." in s) if ":" not in s or s.count(":") == 7 else None
    if kind == 2:
        return float(14 <= len(digits) <= 19 and luhn(digits))
    if kind == 3:
        return 1.0 if cue and 9 <= len(digits) <= 15 else 0.0 if AGAINST.search(left) or len(digits) < 9 else None
    mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and len(set(s)) >= 8
    given = cue and re.search(r"[:=]\s{0,2}[\"']?$", left)
    return 1.0 if given and mixed else 0.0 if not cue and not (mixed and len(s) >= 20) else None


def made_up(r: random.Random) -> tuple[str, str, bool]:
    """A text in one of the kinds, at random: what stands before, the text itself, and whether it is personal data or a secret in an unusual form, or looks like one."""
    def of(signs, n: int) -> str:
        bits, out = len(signs).bit_length(), []
        while len(out) < n:  # as r.choice of each, without its calls
            if (k := r.getrandbits(bits)) < len(signs):
                out.append(signs[k])
        return "".join(out)

    d = lambda n: of("0123456789", n)
    word = lambda: of(("an", "er", "in", "the", "tion", "ou", "re", "st", "le", "de"), r.randint(1, 3))

    def card(valid: bool, gap: str) -> str:
        body = r.choice("3456") + d(14)
        number = body + next(c for c in "0123456789" if luhn(body + c) == valid)
        return gap.join(number[i : i + 4] for i in range(0, 16, 4))

    kind, real = r.randrange(len(KINDS)), r.random() < 0.5
    if kind == 0:
        host, top = word(), r.choice(sorted(TOP_LEVEL))
        if real:
            at, dot = r.choice(((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("@", "."), (" @ ", "."), ("(at)", ".")))
            return r.choice(("email: ", "contact ", "", "reach me ")), f"{word()}{r.choice('._-')}{word()}{at}{host}{dot}{top}", True
        return r.choice(("", "look ")), r.choice((f"{word()} at {word()}.{word()}", f"{word()} at {word()} dot {word()}", f"{word()} at {d(1)}.{d(2)}", f"{word()} @ {d(2)}.{d(2)}", f"{word()} at {word()}. {word().title()}")), False
    if kind == 1:
        if real:
            parts = [str(r.randint(1, 255)) for _ in range(4)]
            return r.choice(("host ", "ip ", "server ", "")), r.choice(("[.]".join(parts), "(.)".join(parts), ":".join(f"{r.randrange(65536):x}" for _ in range(8)), " . ".join(parts))), True
        return r.choice(("version ", "section ", "table ", "")), r.choice((".".join(str(r.randint(256, 999)) for _ in range(4)), f"{d(1)} . {d(1)} . {d(1)} . {d(1)}", ":".join(d(2) for _ in range(6)))), False
    if kind == 2:
        if real:
            return r.choice(("card ", "visa ", "pay with ", "")), card(True, r.choice((".", "/", "  ", "_", "--"))), True
        return r.choice(("order ", "serial ", "id ", "")), r.choice((card(False, r.choice(" -./")), card(False, ""), d(20), " ".join(d(4) for _ in range(5)))), False
    if kind == 3:
        if real:
            return r.choice(("phone ", "call ", "tel. ", "fax ", "mobile: ")), r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)} {d(4)}")), True
        return r.choice(("", "total ", "date ", "page ", "order ", "isbn ")), r.choice((f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}-{d(2)}-{d(2)}", f"{d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)} {d(4)}")), False
    hexes, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    if real:
        name = r.choice(("token", "api_key", "api-key", "secret", "access_token", "password", "auth key"))
        if r.random() < 0.1:
            return r.choice(("", "key:\n", f"{name}: ")), f"-----BEGIN {(owner := r.choice(('RSA ', 'EC ', 'OPENSSH ', '')))}PRIVATE KEY-----\n" + "\n".join(of(letters + "+/", 64) for _ in range(r.randint(1, 12))) + f"\n-----END {owner}PRIVATE KEY-----", True
        if r.random() < 0.2:
            return r.choice(("bearer ", "token: ", "auth: ", f"{name}=")), r.choice((f"eyJ{of(letters, r.randint(20, 40))}.eyJ{of(letters, r.randint(30, 160))}.{of(letters + '_-', 43)}", of(letters, r.randint(100, 400)))), True
        return r.choice((f"{name} = \"", f"{name}: ", f"{name}=", f"{name} = ", f"{name}: '")), r.choice((of(hexes, r.choice((32, 40, 64))), of(letters, r.randint(20, 44)), "sk-" + of(letters, 24), "ghp_" + of(letters, 36), "AKIA" + of(letters[:26] + letters[-10:], 16))), True
    return r.choice(("", "see ", "key point ", "version ")), r.choice((f"{word()}_{word()}_{word()}{word()}_{d(2)}", f"{word()}/{word()}{word()}/{word()}{d(1)}/{word()}", f"{word()}-{word()}{word()}-{word()}-{word()}-20{d(2)}", f"{word()}{word()}{word()}{word()}{d(1)}{word()}")), False


def examples(text: str, seed: int, spliced: int = 4) -> tuple[list[list[float]], list[float]]:
    """Features and labels of candidates of one document: all its own, as weak_label tells, and so many made-up texts written between its words."""
    r, rows, labels = random.Random(seed), [], []
    base = set(base_spans(text))
    for c in sorted(base | set(candidates(text))):
        label = weak_label(text, c, base)
        if label is not None:
            rows.append(features(text, c))
            labels.append(label)
    for _ in range(spliced):
        before, what, real = made_up(r)
        at = r.randint(0, len(text))
        left, right = text[max(0, at - 3 * AROUND) : at].rpartition(" ")[0], text[at : at + 3 * AROUND].partition(" ")[2]
        lead = f"{left} {before}"
        window = f"{lead}{what}{r.choice((' ', '. ', ', ', chr(34) + ' '))}{right}"
        start, end = len(lead), len(lead) + len(what)
        for c in candidates(window):
            if c[0] < end and c[2] > start and ("\n" not in what or (c[0], c[2]) == (start, end)):  # lines of a framed key are no examples of their own
                rows.append(features(window, c))
                labels.append(float(real and c[0] == start and c[2] == end))
    return rows, labels


class Model:
    """Boosted trees as arrays, and a threshold for each kind."""

    def __init__(self, trees: list[tuple[float, list]], thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        for weight, nodes in self.trees:
            at = np.zeros(len(rows), np.int64)
            feature, threshold, left, right, value = nodes
            while (inner := left[at] >= 0).any():
                go_left = rows[np.arange(len(rows)), feature[at]] <= threshold[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def _arrays(root) -> tuple[np.ndarray, ...]:
    """A tree of the JVM as arrays, breadth first; leaves have no left child, -1."""
    out, queue = [], [root]
    for node in queue:  # grows as it goes
        if node.getClass().getSimpleName() == "InternalNode":
            out.append((node.split().featureIndex(), node.split().threshold(), len(queue), len(queue) + 1, node.prediction()))
            queue += [node.leftChild(), node.rightChild()]
        else:
            out.append((0, 0.0, -1, -1, node.prediction()))
    feature, threshold, left, right, value = zip(*out)
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


def training_rows(docs: DataFrame, most: int | None, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(h, features array<double>, label double) of the examples of all documents; h is a hash of id and text.

    With most, of so many documents only, those of smallest h, half of them at most with a digit or an @. Null texts are the empty text, whose
    examples are made-up ones only.
    """
    chosen = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if most is not None:
        rows, signed = chosen, F.col("text").rlike("[0-9@]")
        least = lambda where, n: rows.where(where).select("h").distinct().orderBy("h").limit(n)
        hashes = least(signed, most // 2).unionByName(least(~signed, most - most // 2))
        chosen = rows.join(F.broadcast(hashes), "h", "left_semi").dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, rows, labels = [], [], []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text")):
                found, told = examples(text.as_py(), seed ^ h)
                names += [h] * len(told)
                rows += found
                labels += told
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["h", "features", "label"])
        let_go()

    return chosen.mapInArrow(run, "h long, features array<double>, label double")


def train(rows: DataFrame, seed: int) -> GBTClassificationModel:
    """Boosted trees on all rows of features and label, dealt out by h to partitions of about FIT_ROWS, each in a fixed order.

    In one partition reruns agree; sums over several are made in the order in which they come, and may differ in the last digit.
    """
    dealt = rows.repartition(rows.count() // FIT_ROWS + 1, "h").sortWithinPartitions("h", "features", "label")
    frame = dealt.select(array_to_vector("features").alias("features"), "label")
    return GBTClassifier(maxIter=16, maxDepth=4, stepSize=0.3, seed=seed).fit(frame)


def trees_of(fitted: GBTClassificationModel) -> list[tuple[float, tuple]]:
    return [(w, _arrays(t._call_java("rootNode"))) for w, t in zip(fitted.treeWeights, fitted.trees)]


def calibrated(p: np.ndarray, labels: np.ndarray, precision: float, counts: np.ndarray | None = None) -> float:
    """The least probability, one half at least, from which on all choices together are right as often as precision asks; above 1 if there is none.

    With counts, a place stands for so many choices, labels of which are right.
    """
    order = np.argsort(-p, kind="stable")
    right, chosen = np.cumsum(labels[order]), np.cumsum(np.ones(len(p)) if counts is None else counts[order])
    last = np.append(p[order][1:] < p[order][:-1], True)[: len(p)]  # rows of one probability are chosen together
    good = np.flatnonzero((right / chosen >= precision) & (p[order] >= 0.5) & last)
    return float(p[order][good[-1]]) if len(good) else 1.1


def _cells(rows: DataFrame, model: Model) -> DataFrame:
    """(kind, cell, n, good): how many of rows (features, label) the model gives a probability of cell / CELLS or just above, and of how many the label is 1."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, len(NAMES))
            cell = np.floor(held.value.probabilities(x) * CELLS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, : len(KINDS)].argmax(axis=1).astype(np.int32)), pa.array(cell), batch.column("label")], ["kind", "cell", "label"])
        let_go()

    told = rows.select("features", "label").mapInArrow(run, "kind int, cell int, label double")
    return told.groupBy("kind", "cell").agg(F.count("*").alias("n"), F.sum("label").alias("good"))


def fit(docs: DataFrame, most: int | None = None, precision: float = 0.995, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Boosted trees on the examples of all documents (of `most` at most, if given), and a threshold for each kind, calibrated on a fifth of them that the trees don't see.

    The driver gets the model, and for each kind counts by CELLS steps of probability. An empty table gives a model that adds nothing.
    """
    rows = materialize(training_rows(docs, most, seed, id_col, text_col), "examples")
    held = F.pmod("h", F.lit(5)) == 0
    learned = rows.where(~held)
    model = Model([], [1.1] * len(KINDS))
    if learned.agg(F.count_distinct("label")).first()[0] == 2:
        model.trees = trees_of(train(learned, seed))
        kept = _cells(rows.where(held), model).where(F.col("cell") >= CELLS // 2).toArrow()
        kind, cell, n, good = (kept.column(c).to_numpy() for c in ("kind", "cell", "n", "good"))
        for k in range(len(KINDS)):
            own = kind == k
            model.thresholds[k] = calibrated(cell[own] / CELLS, good[own], precision, n[own])
    release(rows)
    return model


def spans(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and these with the spans that the model adds: the likeliest first, if they overlap none before."""
    base = base_spans(text)
    more = [c for c in candidates(text) if not any(c[0] < b[2] and b[0] < c[2] for b in base)]
    if not more:
        return base, base
    p = model.probabilities(np.array([features(text, c) for c in more]))
    added: list[tuple[int, int, int]] = []
    for k in np.argsort(-p, kind="stable"):
        c = more[k]
        if p[k] >= model.thresholds[c[1]] and not any(c[0] < a[2] and a[0] < c[2] for a in added):
            added.append(c)
    return base, sorted(base + added)


def _written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def personal_data(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, found): a row per row.

    The counts of kinds and base_sha256 are of the base spans; spans and n_spans are of all spans, and found has these as structs (kind, start, end, added), in
    code points. Added spans are of KINDS, among them secrets, which have no base pattern. A null text is the empty text and has none. Ids may be null or repeat: rows are handled one by
    one. Other columns are ignored. No rows give no rows. Texts are searched whole; spans have
    any length that their patterns allow.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    names = ["n_email", "n_ip", "n_card", "n_phone"]
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, digest, written, found = [[] for _ in range(BASE)], [], [], []
            for text in batch.column("text"):
                base, every = spans(text.as_py(), held.value)
                for k, c in enumerate(counts):
                    c.append(sum(b[1] == k for b in base))
                digest.append(hashlib.sha256(_written(base).encode()).hexdigest())
                written.append(_written(every))
                sure = set(base)
                found.append([{"kind": KINDS[s[1]], "start": s[0], "end": s[2], "added": s not in sure} for s in every])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(written, pa.string()), pa.array([len(x) for x in found], pa.int64()), pa.array(found, found_type)],
                ["id", *names, "base_sha256", "spans", "n_spans", "found"],
            )
        let_go()

    schema = f"id {kind}, {', '.join(n + ' long' for n in names)}, base_sha256 string, spans string, n_spans long, found array<struct<kind: string, start: int, end: int, added: boolean>>"
    return frame.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """(id_col, redacted): each text with its spans replaced by a mark of the kind; of overlapping spans the first stands. Null stays null."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                if text is not None:
                    parts, at = [], 0
                    for a, k, b in spans(text, held.value)[1]:
                        if a >= at:
                            parts += [text[at:a], mark.format(KINDS[k])]
                        at = max(at, b)
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "redacted"])
        let_go()

    return frame.mapInArrow(run, f"id {kind}, redacted string").withColumnRenamed("id", id_col)

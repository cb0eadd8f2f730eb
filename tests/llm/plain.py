"""Plain versions of the training-data operators, in loops and sets, that the Spark ones are held against."""

import collections
import math
import re
import zlib

import regex
import xxhash

M64 = (1 << 64) - 1


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# lines


def plain_lines(rows, hashes, percent=80):
    """The lines to go of each (id, text), by comparing all pairs in the order of id, text hash and number."""
    at = lambda i, t, n: (-1 if i is None else i, hashes[t], n)
    placed = sorted({(at(i, t, n), frozenset(w)) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if (w := re.findall(r"[^\x20\x09-\x0D]+", x.lower()))}, key=lambda x: x[0])
    first = {}
    for p, s in placed:
        first.setdefault(s, p)
    sets = sorted(first.items(), key=lambda x: x[1])
    owners = collections.defaultdict(list)
    gone = set()
    for s, p in sets:
        seen = collections.Counter(o for w in s for o in owners[w])
        if any(100 * both >= percent * (len(s) + len(o) - both) for o, both in seen.items()):
            gone.add(s)
        for w in s:
            owners[w].append(s)
    out = {}
    for i, t in rows:
        out[i, t] = []
        for n, x in enumerate((t or "").split("\n")):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", x.lower()))
            if s and t is not None and (s in gone or first[s] != at(i, t, n)):
                out[i, t].append(n)
    return out


# quality


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & M64
    return h


def plain_features(text, bits=20):
    """A dict from index to value."""
    words = [m.group() for m in regex.finditer(r"\p{L}+|\p{N}+|([^\s\p{L}\p{N}])\1*", text)]
    if not words:
        return {0: [1.0]}
    shapes = []
    for w in words:
        if w[0].isalpha():
            case = "a" if w.islower() else "A" if w.isupper() and len(w) > 1 else "Aa" if w.istitle() else "aA"
            shapes.append(f"\0{case}{min(len(w), 24) // 4}")
        else:
            shapes.append("\0" + ("0" if w[0].isnumeric() else w[:4]))
    counts = collections.Counter()
    for kind, names, most in ((1, words, 2), (2, shapes, 3)):
        hashes = [fnv(x) for x in names]
        for n in range(1, most + 1):
            for k in range(len(hashes) - n + 1):
                h = hashes[k]
                for j in range(k + 1, k + n):
                    h = (h * 0xD6E8FEB86659FD93 + (0x5851F42D4C957F2D if words[j] == words[j - 1] else hashes[j])) & M64
                counts[((h ^ (kind * 16 + n)) * 0x9E3779B97F4A7C15 & M64) >> (64 - bits)] += 1
    value = {k: 1 + math.log(c) for k, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in value.values()))
    out = collections.defaultdict(list)
    out[0].append(1.0)
    for k, v in value.items():
        out[k].append(v / norm)
    return out


class PlainFTRL:
    def __init__(self, alpha=2.0, beta=1.0, l1=0.2, l2=0.2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(self, k):
        z, n = self.z[k], self.n[k]
        return 0.0 if abs(z) <= self.l1 else (math.copysign(self.l1, z) - z) / ((self.beta + math.sqrt(n)) / self.alpha + self.l2)

    def score(self, x):
        return 1 / (1 + math.exp(-sum(self.weight(k) * v for k, vs in x.items() for v in vs)))

    def learn(self, x, label):
        p = self.score(x)
        step = {k: (self.weight(k), (p - label) * vs[0]) for k, vs in x.items()}
        for k, (w, g) in step.items():
            self.z[k] += g - (math.sqrt(self.n[k] + g * g) - math.sqrt(self.n[k])) / self.alpha * w
            self.n[k] += g * g


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


# token counts


def plain_section_tokens(text, tokens, lengths, rule):
    """Tokens of each section: tokens are the byte strings of a text, lengths the characters of its sections."""
    starts = []  # the character of each byte
    for k, c in enumerate(text):
        starts += [k] * len(c.encode())
    section = [s for s, n in enumerate(lengths) for _ in range(n)][: len(text)]
    section += [len(lengths) - 1] * (len(text) - len(section))
    out, at, crossing = [0.0] * len(lengths), 0, 0
    for token in tokens:
        chars = sorted(set(starts[at : at + len(token)]))
        at += len(token)
        shares = collections.Counter(section[c] for c in chars)
        crossing += len(shares) > 1
        if rule == "start":
            out[section[chars[0]]] += 1
        elif rule == "majority":
            out[min(shares, key=lambda s: (-shares[s], s))] += 1
        else:
            for s, n in shares.items():
                out[s] += n / len(chars)
    return out, crossing


# near duplicates


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows, percent):
    """(id, set size, component_id) of each row, and each row's root."""
    sets = [shingle_set(t) for _, t in rows]
    parent, first, owners = list(range(len(rows))), {}, collections.defaultdict(list)
    for a, s in enumerate(sets):
        if not s:
            continue
        if s in first:
            parent[a] = find(parent, first[s])
            continue
        first[s] = a
        for b, both in collections.Counter(o for g in s for o in owners[g]).items():
            if 100 * both >= percent * (len(s) + len(sets[b]) - both):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
        for g in s:
            owners[g].append(a)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(parent, k)].append(i)
    return [(i, len(sets[k]), min(least[find(parent, k)], default=None)) for k, (i, _) in enumerate(rows)], [find(parent, k) for k in range(len(rows))]


# fingerprints


def spark_hash(value, seed=42):
    """xxhash64 as Spark has it, as an unsigned number: of a string, or of longs, each with the hash before as its seed."""
    if isinstance(value, str):
        return xxhash.xxh64_intdigest(value.encode(), seed)
    for v in value:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
    return seed


def plain_sketch(text, scale=4, words=5):
    """A fingerprint's hashes, as signed numbers in order."""
    ws = [spark_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]
    if not ws:
        return []
    runs = {spark_hash(ws[k : k + words]) for k in range(len(ws) - words + 1)} if len(ws) >= words else {spark_hash(ws)}
    signed = sorted(h - (1 << 64) if h >> 63 else h for h in runs)
    return [h for h in signed if h < -(1 << 63) + (1 << 64) // scale] or signed[:1]


def plain_fingerprints(rows):
    """For rows in their order: (id, n_chars, edited, sketch, edited sketch, near_edited, near_next)."""
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        own, changed, following = plain_sketch(t), plain_sketch(edited), plain_sketch(n)
        out.append((i, len(t), edited, own, changed, like(own, changed), like(own, following)))
    return out


# licences


def plain_alignment(template, text, shift, band):
    """The longest common subsequence of which word j of the text may match word i of the template if |j - i - shift| <= band."""
    table = {}
    for i in range(len(template)):
        for j in range(len(text)):
            best = max(table.get((i - 1, j), 0), table.get((i, j - 1), 0))
            if abs(j - i - shift) <= band and template[i] == text[j]:
                best = max(best, table.get((i - 1, j - 1), 0) + 1)
            table[i, j] = best
    return table.get((len(template) - 1, len(text) - 1), 0)


# mixing


def plain_targets(sizes, weights, share=1.5, most=2.0):
    """sizes: words of each source."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    stopped, total = set(), share * sum(sizes.values())
    while True:
        left, w = total - sum(most * sizes[s] for s in stopped), sum(weight[s] for s in order if s not in stopped)
        new = {s for s in order if s not in stopped and left * weight[s] / w > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in stopped else left * weight[s] / w for s in order}
        stopped |= new


def plain_copies(rows, target, size, offset):
    """Copies of the rows of one source, walked in their order: one for each whole number that the running sum crosses."""
    ratio = target / size if size else 0.0
    return [math.floor(offset + ratio * (k + 1)) - math.floor(offset + ratio * k) for k in range(len(rows))]

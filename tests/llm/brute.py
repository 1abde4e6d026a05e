"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    text = text or ""
    spans = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            spans["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans["phone"].append(m.span())
    return spans


def secrets(text):
    text = text or ""
    kinds = ("assign", "access", "hex")
    spans = {k: [] for k in kinds}
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans["assign"].append(m.span())
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            spans["access"].append(m.span())
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 16:
            spans["hex"].append(m.span())
    return spans


def listed(spans, by_kind):
    order = list(spans)
    rows = [(k, s, e) for k in order for s, e in spans[k]]
    rows.sort(key=(lambda r: (order.index(r[0]), r[1])) if by_kind else (lambda r: (r[1], order.index(r[0]))))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in rows)


def removed(rows, window=50):
    """rows: (id, text) -> id -> (n_words, n_removed, sha)."""
    first = {}
    big = lambda i: (i is None, i or 0)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key not in first or big(i) < big(first[key]):
                first[key] = i
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if big(first[tuple(w[k : k + window])]) < big(i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y:
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    root[find(a)] = find(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(s), min(least[find(i)], default=None) if s else d) for i, (d, s) in enumerate(sets)]


def quality(text):
    text = text or ""
    w = words(text)
    count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    rep = [False] * len(w)
    for k in range(len(w) - 4):
        if count[tuple(w[k : k + 5])] > 1:
            rep[k : k + 5] = [True] * 5
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n, r = len(w), sum(rep)
    return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), dup, r, n < 10 or 100 * r > 20 * n


_QUALITY: dict = {}


def fertility(text, folder, vocabulary, pattern, window):
    """Tokens of the whole text at once, and their figures."""
    import tiktoken

    if not _QUALITY:
        with open(f"{folder}/{vocabulary}", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _QUALITY["e"] = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoding = _QUALITY["e"]
    ids = encoding.encode_ordinary(text or "")
    if not ids:
        return 0, 0.0, 0.0, 0.0

    def is_part(token):
        try:
            encoding.decode_single_token_bytes(token).decode()
        except UnicodeDecodeError:
            return True
        return False

    def share(part):
        n = len(part)
        return -sum(c / n * math.log2(c / n) for c in Counter(part).values()) / math.log2(n) if n > 1 else 0.0

    total, n = 0.0, len(ids)
    for low in range(0, n, window):
        new = min(window, n - low)
        part = ids[low : low + window] if new == window else ids[max(0, n - window) :]
        total += new * share(part)
    return n, len(text) / n, sum(map(is_part, ids)) / n, total / n


def contamination(rows, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    patterns = defaultdict(set)
    for i, t in items:
        w = find(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in rows:
        w = find(t)
        hit, found = [False] * len(w), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in patterns:
                    hit[k : k + n] = [True] * n
                    found |= patterns[p]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), sum(hit), len(names), sha(",".join(names)), any(hit)))
    return out


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


class Ppm:
    """Order-3 byte model, method C with exclusion, by dictionaries; a text ends with the byte FF."""

    def __init__(self, texts, order=3):
        self.order = order
        self.counts = defaultdict(Counter)
        for t in texts:
            data = (t or "").encode() + b"\xff"
            padded = bytes(order) + data
            for i, s in enumerate(data):
                context = padded[i : i + order]
                for k in range(order + 1):
                    self.counts[context[order - k :]][s] += 1

    def log10(self, context, symbol):
        cost, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.counts.get(context[self.order - k :], {})
            offered = {s: n for s, n in seen.items() if s not in excluded}
            total, kinds = sum(offered.values()), len(offered)
            if symbol in offered:
                return cost + math.log10(offered[symbol] / (total + kinds))
            if kinds:
                cost += math.log10(kinds / (total + kinds))
            excluded |= set(seen)
        return cost - math.log10(256 - len(excluded))

    def score(self, text):
        data = (text or "").encode() + b"\xff"
        padded = bytes(self.order) + data
        return sum(self.log10(padded[i : i + self.order], s) for i, s in enumerate(data))


def lm(rows):
    train = [t for i, t in rows if not is_held_out(i)]
    counts = Counter(w for t in train for w in words(lower(t)))
    n_docs = len(train)
    total, kinds = sum(counts.values()) + n_docs, len(counts) + (1 if n_docs else 0)
    model = Ppm(train)
    out = []
    for i, t in rows:
        tokens = [counts[w] for w in words(lower(t))] + [n_docs]
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in tokens)
        out.append((i, is_held_out(i), len(tokens), sum(c > 0 for c in tokens), total, base, model.score(t)))
    return out


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def targets(sizes, weights=(1, 2, 3), cap=3.0):
    """source -> target by literal resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in order}
    while True:
        over = {s for s in order if target[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        excess = sum(target[s] - cap * sizes[s] for s in over)
        for s in over:
            target[s] = cap * sizes[s]
        free = [s for s in order if target[s] < cap * sizes[s]]
        if not free:
            return target
        for s in free:
            target[s] += excess * weight[s] / sum(weight[x] for x in free)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def features(text, longest=3):
    w = terms(text)
    return Counter(" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))


def importance(docs, items, buckets=10_000, percent=5):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) against texts."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for total, texts in ((s, [x for _, x in docs]), (t, items)):
        for text in texts:
            for f, n in features(text).items():
                total[of(f)] += n
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t)))
    out = []
    for i, text in docs:
        found = features(text)
        weight = sum(n * gain(of(f)) for f, n in found.items())
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        out.append([i, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(terms(text)) >= 20])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k in range(percent * len(fit) // 100):
        fit[k][4] = k + 1
    return [tuple(r[:5]) for r in out]


def merkle(rows, fanout=8):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(part, r)))

    def tree(digests):
        """The last node, and of each leaf the (before, after) of its levels."""
        level, place, paths = list(digests), list(range(len(digests))), [[] for _ in digests]
        while len(level) > 1:
            for i, p in enumerate(place):
                low = p - p % fanout
                paths[i].append(("".join(level[low:p]), "".join(level[p + 1 : low + fanout])))
                place[i] = p // fanout
            level = [sha("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
        return level[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    grown = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        grown.append((own, *tree([leaf(r) for r in own])))
    if not grown:
        return []
    root, tops = tree([g[1] for g in grown])
    out = []
    for (own, subroot, paths), top in zip(grown, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            steps = path + top
            digest = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                digest = leaf((*r[:4], None if r[4] is None else lower(r[4])))
            for before, after in steps:
                digest = sha(before + digest + after)
            out.append((r[0], leaf(r), subroot, root, sha("".join(b + a for b, a in steps)), digest, digest == root))
    return out

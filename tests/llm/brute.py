"""Plain Python versions of the contracts, for whole small tables."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    t = text or ""
    w = SPACE.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if grams[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def span_sha(spans):
    return hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def words8(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(text, items, window=8):
    """n_words, n_hit, item ids."""
    w = words8(text)
    hit, found = set(), set()
    at = {}
    for i in range(len(w)):
        at.setdefault(w[i], []).append(i)
    for item, t in items:
        iw = words8(t)
        n = min(window, len(iw))
        for k in range(len(iw) - n + 1) if n else ():
            for i in at.get(iw[k], ()):
                if w[i : i + n] == iw[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def shingles(text, size):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in SPACE.findall(text or "")]
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def jaccard(docs, size, percent):
    """n_shingles and component for each (doc_id, text), by comparing all pairs that share a shingle."""
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        count = Counter(j for x in s for j in where.get(x, ()))
        for j, both in count.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        for x in s:
            where.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def repeats(docs, span=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha) of each (doc_id, text), in the order of the operator."""
    seen = set()
    out = Counter()
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - span + 1):
            w = raw[p : p + span]
            if w in seen:
                gone[p : p + span] = b"\x01" * span
            seen.add(w)
        spans = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out[d, len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()] += 1
    return out


def ppm(docs, order):
    """n_tokens, n_known, N, base, score of each (text, trains), from a trie in plain dicts."""
    import math

    trie, words = defaultdict(Counter), Counter()
    symbols = lambda t: [*(t or "").encode(), 0xFF]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    for t, trains in docs:
        if trains:
            line = [0xFE] * order + symbols(t)
            for i in range(order, len(line)):
                for k in range(order + 1):
                    trie[tuple(line[i - k : i])][line[i]] += 1
            words.update(tokens(t))
    n, v = sum(words.values()), len(words)
    out = []
    for t, _ in docs:
        line = [0xFE] * order + symbols(t)
        score = 0.0
        for i in range(order, len(line)):
            out_of, p = set(), 1.0
            for k in range(order, -1, -1):
                seen = {s: c for s, c in trie[tuple(line[i - k : i])].items() if s not in out_of}
                total = sum(seen.values()) + len(seen)
                if line[i] in seen:
                    p *= seen[line[i]] / total
                    break
                if seen:
                    p *= len(seen) / total
                out_of |= set(seen)
            else:
                p /= max(1, 256 - len(out_of))
            score += math.log10(p)
        w = tokens(t)
        out.append((len(w), sum(words[x] > 0 for x in w), n, sum(math.log10((words[x] + 1) / ((n + 1) * (v + 1))) for x in w), score))
    return out


def kept(docs):
    """Whether the adaptive rules keep each (text, lang, source), from plain sorted lists: quartiles to bucket edges."""
    import math

    step = math.log(1.02)
    rows = []
    for text, lang, source in docs:
        n, chars, _, dups, again, failed = rules(text)
        lines = sum(bool(SPACE.search(x)) for x in (text or "").split("\n"))
        upper = len(re.findall("[A-Z]", text or ""))
        others = sum(not unicodedata.category(c)[0] in "LN" for w in SPACE.findall(text or "") for c in w)
        share = lambda a, b: math.log(a / b) if a > 0 else None
        rows.append((failed, lang or "", source or "", [share(others, chars), share(upper, chars), share(dups, lines), share(again, n), share(chars, n)]))

    def quarts(values, up):
        if not values:
            return None
        b = sorted(math.ceil(v / step) for v in values)
        n = len(b)
        q = [(next(x for i, x in enumerate(b) if 4 * (i + 1) >= n) - 1) * step, next(x for i, x in enumerate(b) if 4 * (i + 1) >= 3 * n) * step]
        return q if up is None else [(n * a + 200 * z) / (n + 200) for a, z in zip(q, up)]

    out = []
    for failed, lang, source, values in rows:
        good = not failed
        for m, v in enumerate(values):
            if v is None:
                continue
            of = lambda test: [r[3][m] for r in rows if not r[0] and r[3][m] is not None and test(r)]  # noqa: E731, B023
            q = quarts(of(lambda r: r[1:3] == (lang, source)), quarts(of(lambda r: r[1] == lang), quarts(of(lambda r: True), None)))  # noqa: B023
            if q:
                wide = 3 * (q[1] - q[0])
                good = good and v <= q[1] + wide and (m < 4 or v >= q[0] - wide)
        out.append(good)
    return out


def kd_sizes(rows, shards):
    """Bytes of each leaf of a plain k-d tree over (size, dims) rows, for rows that all differ in a dimension."""
    whole = [max(1, max(r[1][d] for r in rows) - min(r[1][d] for r in rows)) for d in range(len(rows[0][1]))]

    def leaves(part, k):
        if k == 1 or not part:
            return [sum(r[0] for r in part)] + [0] * (k - 1)
        extent = lambda d: (max(r[1][d] for r in part) - min(r[1][d] for r in part)) / whole[d]
        d = max(range(len(whole)), key=lambda i: (extent(i), -i))
        part = sorted(part, key=lambda r: r[1][d])
        want, below = sum(r[0] for r in part) * (k // 2) / k, 0
        for i, r in enumerate(part):
            if below + r[0] >= want:
                cut = i + (below + r[0] - want < want - below)
                return leaves(part[:cut], k // 2) + leaves(part[cut:], k - k // 2)
            below += r[0]

    return leaves(rows, shards)


_SHORT = re.compile(r"""(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", re.I | re.A)
_SECRET = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_HOST = re.compile(r"(?:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?)")


def linked(text, scope=200):
    """All spans (start, kind, end), weak parts included where their complements are near, by comparing every two."""
    t = text or ""
    base = base_spans(t)
    who = [(m.start(), 3, m.end()) for m in _SHORT.finditer(t) if len(m[1]) >= 3]
    bare = [(m.start(), 4, m.end()) for m in _SECRET.finditer(t) if re.search("[0-9]", m[0])]
    host = [(m.start(), 5, m.end()) for m in _HOST.finditer(t) if len(m[0]) >= 7]
    named = [(m.start(), 6, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) < 12]
    near = lambda a, b: a[0] <= b[2] + scope and b[0] <= a[2] + scope
    apart = lambda a, b: a[2] <= b[0] or b[2] <= a[0]
    pairs = [(a, b) for a in [x for x in base if x[1] == 1] + who for b in [x for x in base if x[1] != 1] + bare + named if near(a, b) and apart(a, b)]
    both = {x for p in pairs for x in p}
    with_hosts = {x for e in host for b in both | set(named) if near(e, b) for x in (e, b)}
    weak = {x for x in both | with_hosts if x[1] > 2 and all(apart(x, b) for b in base)}
    return sorted(set(base) | weak)


def quality(train, good, calibrate, truth, rows, project, bins, ridge):
    """Scores of rows by the ridge solution over all training rows at once, and isotonic means by their max-min formula."""
    import numpy as np

    z = project(train)
    diagonal = np.diag([*[ridge] * (z.shape[1] - 1), 1e-6])
    theta = np.linalg.lstsq(np.vstack([z, np.sqrt(diagonal)]), np.concatenate([good, np.zeros(z.shape[1])]), rcond=None)[0]
    raw = project(calibrate) @ theta
    at = np.clip(((raw + 0.5) / 2 * bins).astype(int), 0, bins - 1)
    used = sorted(set(at.tolist()))
    n = np.array([(at == b).sum() for b in used], dtype=float)
    x = np.array([raw[at == b].sum() for b in used]) / n
    y = np.array([truth[at == b].sum() for b in used]) / n
    mean = lambda v, i, j: (v * n)[i : j + 1].sum() / n[i : j + 1].sum()
    fit = np.array([max(min(mean(y, i, j) for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))])
    blocks = [np.flatnonzero(np.isclose(fit, v)) for v in sorted(set(np.round(fit, 12)))]
    knots = np.array([(mean(x, b[0], b[-1]), fit[b[0]]) for b in blocks])
    return np.clip(np.interp(project(rows) @ theta, knots[:, 0], knots[:, 1]), 0, 1)

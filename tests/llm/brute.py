"""Plain re-implementations that the operators are held against."""

import hashlib
import re
import zlib

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(text):
    return (text or "").translate(FOLD)


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def shingles(text, k=5):
    w = SPACE_WORDS.findall(fold(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs):
    sets = {d: shingles(t) for d, t in docs}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    seen, links = set(), []
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                        links.append((a, b))
    return {d: len(s) for d, s in sets.items()}, components(sets, links)


def secrets(text):
    text, found = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end()))
    found.sort()
    told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
    return tuple(sum(k == n for _, k, _ in found) for n in range(3)), hashlib.sha256(told.encode()).hexdigest(), told


def licenses(text):
    w = WORDS.findall(fold(text))
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def contaminated(text, item, window=13, agree=0.8):
    """Whether some diagonal has a window that agrees well enough; the seeds may miss some of these."""
    t, b = WORDS.findall(fold(text)), WORDS.findall(fold(item))
    n = min(window, len(b))
    if not n:
        return False
    need = n if len(b) < 8 else -(-int(agree * n * 1000) // 1000)
    return any(sum(t[d + j + i] == b[j + i] for i in range(n)) >= need for d in range(-len(b), len(t)) for j in range(len(b) - n + 1) if 0 <= d + j and d + j + n <= len(t))


def bigram_scores(docs):
    """{doc_id: (n_tokens, n_known, N, base, score)} by the formulas, with dictionaries."""
    import math
    from collections import Counter, defaultdict

    def tokens(t):
        return [*SPACE_WORDS.findall(fold(t)), "</s>"]

    def discounts(values):
        n = Counter(values)
        d = {0: 0.0, 1: 0.5, 2: 1.0, 3: 1.5}
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            for i in (1, 2, 3):
                if n[i]:
                    d[i] = min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.0), i)
        return d

    uni, pair = Counter(), Counter()
    for d, t in docs:
        if d is not None and crc(d, 5) != 1:
            w = tokens(t)
            uni.update(w)
            pair.update(zip(["<s>", *w[:-1]], w, strict=True))
    total, followers, contexts = Counter(), defaultdict(list), Counter()
    for (c, w), n in pair.items():
        total[c] += n
        followers[c].append(n)
        contexts[w] += 1
    n_all, v = sum(uni.values()), len(uni)
    dp, dw = discounts(pair.values()), discounts(contexts.values())
    rest = sum(dw[min(k, 3)] for k in contexts.values()) / len(pair) if pair else 1.0
    out = {}
    for d, t in docs:
        w = tokens(t)
        base = sum(math.log10((uni[x] + 0.5) / (n_all + 0.5 * (v + 1))) for x in w)
        score = 0.0
        for c, x in zip(["<s>", *w[:-1]], w, strict=True):
            k = contexts[x]
            p = (max(k - dw[min(k, 3)], 0) / len(pair) if pair else 0.0) + rest / (v + 1)
            if total[c]:
                n = pair[c, x]
                p = max(n - dp[min(n, 3)], 0) / total[c] + sum(dp[min(f, 3)] for f in followers[c]) / total[c] * p
            score += math.log10(p)
        out[d] = (len(w), sum(uni[x] > 0 for x in w), n_all, base, score)
    return out


def line_classes(docs, least=8):
    """{(doc_id, line): (n_words, class)} with every pair of lines compared by its deletion variants."""
    lines = {}
    for d, t in docs:
        for i, x in enumerate((t or "").split("\n")):
            w = tuple(SPACE_WORDS.findall(fold(x)))
            if w:
                lines[d, i] = w
    by_text, links = {}, []
    for key, w in lines.items():
        by_text.setdefault(w, []).append(key)
    for keys in by_text.values():
        links += [(keys[0], k) for k in keys[1:]]
    variants = {}
    for w, keys in by_text.items():
        if len(w) >= least - 1:
            for i in range(len(w)):
                variants.setdefault(w[:i] + w[i + 1 :], []).append((i, w))
    for v, group in variants.items():
        own = by_text.get(v)
        first = {}
        for i, w in group:
            if own and len(w) >= least:
                links.append((own[0], by_text[w][0]))
            if len(w) >= least:
                links.append((first.setdefault(i, by_text[w][0]), by_text[w][0]))
    found = components(lines, links)
    return {k: (len(w), found[k]) for k, w in lines.items()}

"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def repeats(texts, window):
    """(n_words, n_removed, sha256 of what is kept) of each text."""
    split = [plain_words(t) for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def groups(links, keys):
    """The smallest key that each key reaches."""
    top = {k: k for k in keys}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def shingles(text, size=5):
    w = plain_words((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near(rows, percent=75):
    """{doc_id: (n_shingles, component_id, kept)} of (doc_id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    holders, links = defaultdict(list), []
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders[s])
        links += [(i, j) for j, n in common.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
        for s in sets[i]:
            holders[s].append(i)
    top = groups(links, sets)
    return {i: (len(s), top[i], top[i] == i) for i, s in sets.items()}


def leaks(docs, items, overlap=0.6, gram=3):
    """Pairs whose question and answer n-grams are in the document, by comparing all with all."""
    from quire.llm.decontaminate import question_and_answer

    found = set()
    for d, text in docs:
        w = alnum_words(text)
        for i, item in items:
            parts = question_and_answer(item)
            if not any(parts):
                continue
            shares = []
            for p in parts:
                n = min(gram, len(p)) or 1
                mine, there = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)}, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
                shares.append(len(mine & there) / len(mine) if p else 1.0)
            if min(shares) >= overlap:
                found.add((d, i))
    return found


def languages(sample, rows):
    """{id: posterior of each language, by name} of rows (id, text, url, declared[, host]): text likelihoods, declared language, address and host priors."""
    from math import exp, log, sqrt

    from quire.llm import language_id

    names = sorted({x for x, _ in sample})
    grams = lambda t: language_id.trigrams([(t or "").encode()])[0]
    counts = {x: Counter() for x in names}
    first = {}
    for lang, text in sample:  # equal texts count once
        first[text] = min(lang, first.get(text, lang))
    for text, lang in first.items():
        counts[lang].update(grams(text).tolist())
    sums = {x: sum(c.values()) for x, c in counts.items()}
    rate = lambda x, g: log((counts[x][g] + 0.5) / (sums[x] + 0.5 * language_id.BUCKETS))
    mean = {}
    soft = lambda v: [exp(x - max(v)) / sum(exp(y - max(v)) for y in v) for x in v]
    evidence, host = {}, {}
    for i, text, url, said, *given in rows:
        found = Counter(grams(text).tolist())
        n = sum(found.values())
        for g in found:
            if g not in mean:
                mean[g] = sum(rate(x, g) for x in names) / len(names)
        parts = [sum(k * (rate(x, g) - mean[g]) for g, k in found.items()) * min(1, 4 / sqrt(max(1, n))) for x in names]
        match = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "")
        site = match[1].lower() if match else None
        path = re.match(r"[^?#]*?://[^/?#]+/([a-zA-Z]{2})(?:[-_/.?#]|$)", url or "")
        suffix = language_id.SUFFIXES.get((site or "").split(".")[-1])
        code = (said or "").split("-")[0].split("_")[0].lower()
        evidence[i] = [t + language_id.DECLARED * (code == x) + language_id.ADDRESS * (suffix == x) + language_id.ADDRESS * (bool(path) and path[1].lower() == x) for t, x in zip(parts, names, strict=True)]
        host[i] = given[0].lower() if given and given[0] else site
    posterior = {i: soft(v) for i, v in evidence.items()}
    up = lambda h: ".".join(h.split(".")[-2:])
    own, near, whole = defaultdict(list), defaultdict(list), []
    for i, h in host.items():
        if h:
            own[h].append(i)
            near[up(h)].append(i)
            whole.append(i)
    total = lambda ids: [sum(posterior[i][k] for i in ids) for k in range(len(names))]
    base, prior, weight = [(x + 1) / (len(whole) + len(names)) for x in total(whole)], {}, language_id.HOST_WEIGHT
    for h, ids in own.items():
        parent = [(x + weight * b) / (len(near[up(h)]) + weight) for x, b in zip(total(near[up(h)]), base, strict=True)]
        prior[h] = [log((o + weight * p) / (len(ids) + weight)) for o, p in zip(total(ids), parent, strict=True)]
    return {i: soft([x + y for x, y in zip(v, prior[host[i]], strict=True)] if host[i] else v) for i, v in evidence.items()}


def same_language(language, confidence, names, posterior):
    best = max(posterior)
    assert abs(confidence - best) <= 1e-4
    assert language == names[posterior.index(best)] or sorted(posterior)[-1] - sorted(posterior)[-2] < 1e-4

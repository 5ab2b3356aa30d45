"""Plain versions of the operators for small inputs, written apart from them."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import struct
import zlib

import xxhash

SPACE = " \t\n\x0b\f\r"


def words(text):
    return [w for w in re.split("[" + SPACE + "]+", text or "") if w]


def quality_rules(docs, good, buckets=1 << 14, smoothing=1.0, threshold=-0.12):
    """doc -> (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept); docs: (id, text); good: trusted ids."""

    def ending(w):
        return xxhash.xxh64_intdigest(w[-3:].encode(), 42) & 0xFFFF

    def grams(w):
        e, out = [ending(x) for x in w], []
        for i, a in enumerate(e):
            h = xxhash.xxh64_intdigest(struct.pack("<q", a), 42)
            if i + 1 < len(e):
                h = xxhash.xxh64_intdigest(struct.pack("<q", e[i + 1]), h)
            out.append((h - (1 << 64) if h >> 63 else h) % buckets)
        return out

    raw, target = [0] * buckets, [0] * buckets
    for d, t in docs:
        for g in grams(words(t)):
            raw[g] += 1
            target[g] += d in good
    n_raw, n_target = sum(raw), sum(target)
    weight = [math.log((b + smoothing) / (n_target + smoothing * buckets)) - math.log((a + smoothing) / (n_raw + smoothing * buckets)) if n_target else 0.0
              for a, b in zip(raw, target)]
    out = {}
    for d, t in docs:
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        g = grams(w)
        llr = sum(weight[x] for x in g) / len(g) if g else 0.0
        out[d] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, not failed and llr >= threshold)
    return out


def line_dedup(docs, percent=80, least=1):
    """doc -> line numbers that go; docs: (id, text)."""
    seen, gone = [], {}
    for d, t in sorted((x for x in docs if x[0] is not None and x[1]), key=lambda x: x[0]):
        for i, line in enumerate(t.split("\n")):
            s = set(words(line))
            if len(s) < least:
                continue
            for other in seen:
                if 100 * min(len(s), len(other)) >= percent * max(len(s), len(other)):
                    common = len(s & other)
                    if 100 * common >= percent * (len(s) + len(other) - common):
                        gone.setdefault(d, set()).add(i)
                        break
            seen.append(s)
    return gone


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    """node -> smallest node reachable."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash(docs, radius=4):
    """doc -> (fingerprint, component)."""
    prints = {d: fingerprint(t) for d, t in docs}
    ids = sorted(prints)
    found = components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (prints[a] ^ prints[b]).bit_count() <= radius])
    return {d: (f"{prints[d]:016x}", found[d]) for d in ids}


def water(children, budget):
    """Splits a budget among {name: (weight, capacity)}: shares by weight, what one can't use goes to the others."""
    given = {c: 0.0 for c in children}
    open_ = {c for c, (w, cap) in children.items() if w > 0 and cap > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[c][0] for c in open_)
        full = [c for c in open_ if given[c] + left * children[c][0] / total >= children[c][1]]
        if not full:
            for c in open_:
                given[c] += left * children[c][0] / total
            break
        # the fullest first: those that can't bear their share are filled up, the rest is dealt anew
        part = {c: children[c][1] - given[c] for c in full}
        for c in full:
            given[c] = float(children[c][1])
        left -= sum(part.values())
        open_ -= set(full)
    return given


def mix(docs, weights, share=1.0, epochs=2, seed=7):
    """doc -> (copies, last epoch); docs: (id, text, lang, source)."""

    def domain(source):
        m = re.search(r"\d+", source or "")
        return "d" + (str(int(m[0]) % 4) if m else "")

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    rows = [(d, (domain(s), lang or "", s or ""), len(words(t))) for d, t, lang, s in docs]
    tokens = collections.Counter()
    for _, leaf, n in rows:
        tokens[leaf] += n
    w = lambda level, name: weights.get(level, {}).get(name, 1)
    usable = lambda leaf: all(w(level, name) > 0 for level, name in zip(("domain", "lang", "source"), leaf))
    cap = lambda keep: epochs * sum(n for leaf, n in tokens.items() if keep(leaf) and usable(leaf))
    budget = {}
    top = water({d: (w("domain", d), cap(lambda x, d=d: x[0] == d)) for d in {x[0] for x in tokens}}, share * sum(tokens.values()))
    for d, b in top.items():
        mid = water({k: (w("lang", k), cap(lambda x, k=k: x[:2] == (d, k))) for k in {x[1] for x in tokens if x[0] == d}}, b)
        for k, c in mid.items():
            low = water({s: (w("source", s), cap(lambda x, s=s: x == (d, k, s))) for s in {x[2] for x in tokens if x[:2] == (d, k)}}, c)
            budget.update({(d, k, s): v for s, v in low.items()})
    out = {}
    for leaf, n in tokens.items():
        whole = int(budget[leaf] / n + 1e-9) if n else 0
        left, before = budget[leaf] - whole * n, 0
        key = lambda r: (md5(f"{seed}:{whole}:{md5(f'{seed}:{r[0]}')[:3]}"), md5(f"{seed}:{r[0]}")[:3], md5(f"{seed}:{whole}:{r[0]}"), r[0])
        for r in sorted((x for x in rows if x[1] == leaf), key=key):
            last = r[2] > 0 and before < left - 1e-6
            if r[2] > 0 and whole + last:
                out[r[0]] = (whole + last, last)
            before += r[2]
    return out


def prefix_trie(rows):
    """Nodes (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, sha of ends) of rows (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        ends[built].append(c)
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(words(p[-1][1])) if p else 0
            leaves[p[:d]] += not children[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def fill_in_middle(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return n, "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle

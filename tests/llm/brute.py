"""Plain versions of the operators' rules, one text at a time."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def repeats(docs):
    """docs: (doc_id, text) in order. Rows as op1 returns them."""
    seen, out = set(), []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(data[p : p + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def contaminated(text, items):
    """n_words, n_hit, n_items, items_sha256, contaminated."""
    own, hit, listed = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for p in range(len(own) - n + 1) if n else ():
            if tuple(own[p : p + n]) in windows:
                hit |= set(range(p, p + n))
                if item_id is not None:
                    listed.add(str(item_id))
    return len(own), len(hit), len(listed), hashlib.sha256(",".join(sorted(listed)).encode()).hexdigest(), bool(hit)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_copies(docs, radius=2):
    """(doc_id, fingerprint, component_id) of each row."""
    prints = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                group[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (doc_id, _) in enumerate(docs):
        r = root(i)
        least[r] = doc_id if least[r] is None else least[r] if doc_id is None else min(least[r], doc_id)
    return [(d, f"{p:016x}", least[root(i)]) for i, ((d, _), p) in enumerate(zip(docs, prints))]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4)
    return total % 10 == 0


def personal(text):
    """(kind, start, end) of the fixed forms."""
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, form, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def verdict(url, rules):
    """host, path, rule, verdict of the rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host):])[0]
    fits = [(len(r.text), r.text, r.verdict) for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def unigram(docs):
    """(held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", low(t).encode()) + [None] for _, t in docs]
    out = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs]
    c = Counter(w for ws, o in zip(tokens, out) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    return [(o, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for ws, o in zip(tokens, out)]


def context_tree(docs, depth=5):
    """log10 of the probability of each text: context-tree weighting by its definition, for each binary decision."""
    rows = [b"".join(w + b" " for w in re.findall(rb"[^\x20\x09-\x0D]+", low(t).encode())) + b"\n" for _, t in docs]
    out = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs]
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def decisions(text):
        padded = b"\n" * depth + text
        for i in range(depth, len(padded)):
            context = padded[i - depth : i][::-1]  # the nearest byte first
            bits = f"{padded[i]:08b}"
            yield [(bits[:k], int(bits[k]), context) for k in range(8)]

    for text, o in zip(rows, out):
        for path in decisions(text) if not o else ():
            for node, bit, context in path:
                for d in range(depth + 1):
                    counts[node, context[:d]][bit] += 1
                    if d:
                        children[node, context[: d - 1]].add(context[:d])

    @functools.cache
    def own(node, context):
        a, b = counts.get((node, context), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)

    @functools.cache
    def weighted(node, context):
        if len(context) == depth:
            return own(node, context)
        x, y = own(node, context), sum(weighted(node, c) for c in children.get((node, context), ()))
        return max(x, y) + math.log1p(math.exp(-abs(x - y))) + math.log(0.5)

    @functools.cache
    def one(node, whole, d):
        a, b = counts.get((node, whole[:d]), (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if d == depth:
            return estimate
        share = math.exp(own(node, whole[:d]) + math.log(0.5) - weighted(node, whole[:d]))
        return share * estimate + (1 - share) * one(node, whole, d + 1)

    return [sum(math.log10(p if bit else 1 - p) for path in decisions(t) for node, bit, context in path for p in [one(node, context, 0)]) for t in rows]


def kneser_ney(texts, order, classes, symbols):
    """p(gram) by dictionaries; symbols: text -> list of classes."""
    top = Counter()
    for text in texts:
        s = [26] * (order - 1) + symbols(text)
        top.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / classes
        of = Counter(counts[k].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
        d = [0.0] + [min(max(i - (i + 1) * y * of[i + 1] / of[i], 0), i) if of[i] and of[i + 1] else 0.5 * i for i in (1, 2, 3)]
        same = [n for g, n in counts[k].items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        n = counts[k][gram]
        return (n - d[min(n, 3)]) / sum(same) * (n > 0) + sum(d[min(x, 3)] for x in same) / sum(same) * p(gram[1:])

    return p


def conversation(conv_id, rows):
    """rows: (turn, role, text) as given. A row as op12 returns it, by trying edits cheapest first."""
    after = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        after += [(turn, role, text)] * (2 if kind == 3 else 1)
    return repaired(conv_id, after)


def repaired(conv_id, rows):
    """rows: (turn, role, text), after damage. Sorted here by turn, role and text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub("[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = {(0, ""): (0, "", ())}  # (rows read, initials) -> cost, audit, lines; initials shortened to their last
    done = {}
    while best:
        at = min(best, key=lambda k: best[k][:2])
        cost, audit, lines = best.pop(at)
        if at in done:
            continue
        done[at] = cost, audit, lines
        i, last = at
        if i == len(rows) and last in ("", "a"):
            kept = "\n".join(lines)
            count = Counter(faults)
            return (conv_id, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(kept.encode()).hexdigest())
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        ways = [("I", 2, i, x, ({"u": "user:", "a": "assistant:"}[x],)) for x in follow if x != "s"]
        if i < len(rows):
            _, role, text = rows[i]
            ways.append(("D", 3, i + 1, last, ()))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                ways += [("K", extra, i + 1, x, (f"{role}:{text}",)) for x in follow if role[:1] == x]
                ways += [("R", 2 + extra, i + 1, x, (f"{ {'u': 'user', 'a': 'assistant'}[x]}:{text}",)) for x in follow if x != "s"]
        for letter, more, j, x, line in ways:
            way = (cost + more, audit + letter, lines + line)
            if (j, x) not in done and ((j, x) not in best or way[:2] < best[j, x][:2]):
                best[j, x] = way


def variants(docs, every=199):
    """docs: (doc_id, text). Rows as op13 returns them."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    by_hole = defaultdict(set)  # words that are near share a word with a letter left out or blotted out
    for w in n:
        by_hole[w].add(w)
        for i in range(len(w)):
            by_hole[w[:i] + w[i + 1 :]].add(w)
            by_hole[w[:i] + "?" + w[i + 1 :]].add(w)
    near = {w: {o for i in range(len(w)) for hole in (w, w[:i] + w[i + 1 :], w[:i] + "?" + w[i + 1 :]) for o in by_hole[hole] if is_near(w, o)} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

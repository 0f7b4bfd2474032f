"""Plain versions of the operators, over lists of (doc_id, text)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def shingles(text, n):
    w = SPACED.findall(lower(text))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(docs, n, num, den=100):
    """doc_id -> (set size, smallest doc_id of the group)."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    top = {i: i for i, _ in docs}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def contaminated(docs, items, n=10):
    """doc_id -> (words, hit words, sorted item ids)."""
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[i:i + n])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def repeated(docs, span=200):
    """(doc_id, bytes, removed, spans, hash of what is kept)."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[k:k + span] for _, b in raw for k in range(len(b) - span + 1))
    out = []
    for i, b in raw:
        mark = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if count[b[k:k + span]] > 1:
                mark[k:k + span] = b"\1" * span
        spans = sum(1 for k in range(len(mark)) if mark[k] and (not k or not mark[k - 1]))
        out.append((i, len(b), sum(mark), spans, sha(bytes(x for x, m in zip(b, mark) if not m))))
    return out


def tokens(docs, tokenizer, end=2):
    import struct

    start, out = 0, []
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def pieces(docs, model):
    out = []
    for i, t in docs:
        ids = model.encode(t or "")
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids) if ids else "")))
    return out


def quality_counts(text):
    text = text or ""
    w = SPACED.findall(text)
    five = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {i + k for i in range(len(w) - 4) if five[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(lines)


def quality(rows, least=100):
    """rows: (doc_id, text, lang, source). (doc_id, five counts, base failed, kept)."""
    rates, counts = [], []
    for _, text, lang, source in rows:
        n, chars, symbols, dup, rep, lines = c = quality_counts(text)
        counts.append(c)
        rates.append({"symbol": symbols * 1000 // (n + 50), "dup": dup * 1000 // (lines + 10), "rep": rep * 1000 // (n + 50),
                      "length": chars * 100 // n if n >= 50 else None})
    bucket = lambda v: v - v % (1 << max(v.bit_length() - 6, 0))
    group = defaultdict(list)
    for (_, _, lang, source), r in zip(rows, rates):
        for name, v in r.items():
            if v is not None:
                for key in ((lang, source), (lang,), ()):
                    group[key, name].append(bucket(v))
    spread = {"symbol": 30, "dup": 50, "rep": 50, "length": 60}
    out = []
    for (i, _, lang, source), r, c in zip(rows, rates, counts):
        failed, good = c[0] < 10 or 100 * c[4] > 20 * c[0], True
        for name, v in r.items():
            if v is None:
                continue
            own = group[(lang, source), name]
            values = sorted(own if len(own) >= least else group[(lang,), name] if len(group[(lang,), name]) >= least else group[(), name])
            q1, q3 = (values[-(-len(values) * q // 4) - 1] for q in (1, 3))
            reach = 3 * max(q3 - q1, spread[name])
            good &= v <= q3 + reach and (name != "length" or v >= q1 - reach)
        out.append((i, *c[:5], failed, not failed and good))
    return out


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def collocations(rows, threshold=100, longest=5, top=2000):
    """rows: (lang, text)."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall("[^\x20\t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    many = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= threshold}
    most = Counter()
    for (lang, w), a in many.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                most[lang, w[i:i + k]] = max(most[lang, w[i:i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in many.items():
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        if most[lang, w] < a:
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang in out for rank, (s, a, p, left, right) in enumerate(sorted(out[lang])[:top], 1)]


def merkle(rows, fan=16):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + fan])) for i in range(0, len(levels[-1]), fan)])
        return levels

    def steps(levels, i):
        for level in levels[:-1]:
            first = i // fan * fan
            yield level[first:i], level[i + 1:first + fan]
            i //= fan

    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(((r[0] is not None, r[0] or 0), leaf(r, r[4]), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    built = [tree([x[1] for x in sorted(by_source[s], key=lambda x: x[:2])]) for s in sources]
    top = tree([b[-1][0] for b in built])
    out = []
    for j, s in enumerate(sources):
        for i, (_, own, r) in enumerate(sorted(by_source[s], key=lambda x: x[:2])):
            path = [*steps(built[j], i), *steps(top, j)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf(r, lower(r[4])) if changed else own
            for before, after in path:
                node = sha("".join([*before, node, *after]))
            out.append((r[0], own, built[j][-1][0], top[-1][0], sha("".join(x for p in path for q in p for x in q)), node, node == top[-1][0]))
    return out


def sum_of_squares(sizes, length):
    """Fill at which each item is placed."""
    levels, out = [], []
    for size in sizes:
        best = None
        for h in {0, *(x for x in levels if x + size <= length)}:
            count = Counter(levels)
            count[h] -= bool(h)
            count[h + size] += h + size < length
            rank = (sum(v * v for v in count.values()), -h)
            best = min(best or (rank, h), (rank, h))
        h = best[1]
        out.append(h)
        if h:
            levels.remove(h)
        if h + size < length:
            levels.append(h + size)
    return out


def near(text, notice, own, edits, own_edits):
    """(edits, end) of the best place where the notice stands with at most so many edits, ``own_edits`` of them in its words ``own``, which
    are whole words; [] for none. Edit distances to any substring, of what stands before the own words and of what stands behind."""
    before, behind = notice.split(own)

    def distances(pattern, s):
        """Fewest edits between the pattern and any substring of s that ends at each place."""
        row = [0] * (len(s) + 1)
        for i, c in enumerate(pattern, 1):
            last, row = row, [i]
            for j, d in enumerate(s, 1):
                row.append(min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1))
        return row

    def exact(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row = row, [i]
            for j, d in enumerate(b, 1):
                row.append(min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1))
        return row[-1]

    found = []
    ends = {m.end() for m in re.finditer("[^ ]+", text)}
    for m in re.finditer("[^ ]+", text):
        for end in range(m.start() + len(own) - own_edits, m.start() + len(own) + own_edits + 1):
            # Words with nothing at their own places are far more edits than allowed.
            if end not in ends or len(set(own) & set(text[m.start():end])) + own_edits < len(set(own)):
                continue
            middle = exact(own, text[m.start():end])
            if middle > own_edits:
                continue
            left = distances(before, text[max(m.start() - 2 * len(notice), 0):m.start()])[-1]
            right = distances(behind[::-1], text[end:end + 2 * len(notice)][::-1])[-1]
            if left + middle + right <= edits:
                found.append((left + middle + right, end))
    return [min(found)] if found else []

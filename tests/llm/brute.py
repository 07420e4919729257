"""Brute-force counterparts, written plainly and without the package."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring_dedup(rows, window=20):
    """rows: (doc_id, text) in order of occurrence."""
    seen, gone = set(), {}
    for doc, text in rows:
        ws = words(text)
        drop = gone.setdefault(doc, set())
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            if w in seen:
                drop.update(range(i, i + window))
            seen.add(w)
    out = {}
    for doc, text in rows:
        ws = words(text)
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone[doc])
        out[doc] = (len(ws), len(gone[doc]), hashlib.sha256(kept.encode()).hexdigest())
    return out


def suffix_array_dedup(rows, window=200):
    texts = {doc: (text or "").encode() for doc, text in rows}
    times = Counter(t[i : i + window] for t in texts.values() for i in range(len(t) - window + 1))
    out = {}
    for doc, t in texts.items():
        drop = [False] * len(t)
        last = -1
        for i in range(len(t) - window + 1):
            if times[t[i : i + window]] > 1:
                for j in range(max(i, last), i + window):
                    drop[j] = True
                last = i + window
        kept = bytes(b for b, d in zip(t, drop) if not d)
        spans = sum(d and (i == 0 or not drop[i - 1]) for i, d in enumerate(drop))
        out[doc] = (len(t), sum(drop), spans, hashlib.sha256(kept).hexdigest())
    return out


def ngram_join(rows, percent=85, n=4):
    sets = {}
    for doc, text in rows:
        ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def quality_base(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    times = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {j for i in range(len(ws) - 2) if times[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(ws) < 50 or 100 * len(hit) > 50 * len(ws)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed)


def slots(names, size):
    """Slot -> index of the shard that claims it, shards taking turns by their own order of preference."""
    import zlib

    order = [[(zlib.crc32(f"offset:{s}".encode()) + j * (zlib.crc32(f"skip:{s}".encode()) % (size - 1) + 1)) % size for j in range(size)] for s in names]
    owner, at = {}, [iter(o) for o in order]
    while len(owner) < size:
        for i, wish in enumerate(at):
            free = next((s for s in wish if s not in owner), None)
            if free is not None:
                owner[free] = i
    return owner


def line_verdict(text, boilerplate):
    """(kept, words that stay) by the line rules, for texts that pass the base rules."""
    seen, lost, total = set(), 0, 0
    for line in (text or "").split("\n"):
        ws = words(line)
        if not ws:
            continue
        ascii_ = [c for c in line if c.isascii() and c.isalpha()]
        bad = line in seen
        bad |= 100 * sum(all(c in "|>/-" for c in w) for w in ws) >= 15 * len(ws)
        bad |= 100 * sum(c in "#*$%&|<>" for c in line) >= 50 * len(ws)
        bad |= 100 * sum(w.endswith("!!") for w in ws) >= 50 * len(ws)
        bad |= len(ws) >= 5 and any(c.isupper() for c in ascii_) and 100 * sum(c.isupper() for c in ascii_) >= 80 * len(ascii_)
        bad |= len(ws) < 3 and ws[-1][-1] not in ".!?\"')"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
        bad |= any(p in low for p in boilerplate)
        seen.add(line)
        total += len(ws)
        lost += len(ws) * bad
    return 100 * lost <= 50 * total, total - lost


def fill_middle(doc, text):
    """n, form, prefix_chars, middle_chars, output of one text."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def planted_words(doc, text):
    import zlib

    ws = words(text)
    h = zlib.crc32(str("" if doc is None else doc).encode())
    g, n = h // 10, len(ws)
    if h % 10 or not n:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def runs(ws, least=6, times=4):
    """Every maximal repetition, by trying each period; those that a smaller period explains are left out."""
    out = {}
    for p in range(1, len(ws) // times + 1):
        j = 0
        while j + p < len(ws):
            start = j
            while j + p < len(ws) and ws[j] == ws[j + p]:
                j += 1
            if j - start + p >= max(least, times * p) and j > start:
                out.setdefault((start, j - start + p), p)
            j += 1
    return sorted((s, n, p) for (s, n), p in out.items())


def collapse(ws, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def secrets(text, patterns):
    """patterns: (kind, regex with the tail as its last group, least tail); base order is theirs."""
    out = []
    for rank, (kind, pattern, least) in enumerate(patterns):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m.group(m.lastindex)) >= least:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


def decontaminate(docs, items, rules):
    """{(doc, item): (n_windows, n_matched, verbatim)} by comparing every place of every document with every place of every item."""
    import math

    import regex

    def split(text):
        bare = regex.sub(r"[^\p{L}\p{N}\x20\x09-\x0D]+", "", text or "").split()
        kinds = []
        for w in bare:
            if regex.fullmatch(r"\p{Lu}\p{L}*\p{Ll}\p{L}*", w):
                kinds.append("<name>")
            elif "0" <= w[0] <= "9":
                kinds.append("<num>")
            else:
                kinds.append("<unit>" if kinds and kinds[-1] == "<num>" and w.lower() in rules.UNITS else w.lower())
        return [w.lower() for w in bare], kinds

    def windows(raw, kinds):
        n, out, covered = len(raw), [], set()
        own = min(n, rules.SPAN)
        for p in range(n - own + 1):
            out.append((p, own, True))
            for span in {own, rules.LONG_SPAN}:
                if p + span <= n and sum(not k.startswith("<") for k in kinds[p : p + span]) >= rules.MIN_LITERALS:
                    out.append((p, span, False))
                    if span <= rules.SPAN:
                        covered |= set(range(p, p + span))
        return [w for w in out if w[1] <= rules.SPAN or len(covered) < n * rules.MIN_SHARE], n - own + 1

    def mapped(pairs):
        counts = [(sum(p[1:] == k for p in pairs), *k) for k in {p[1:] for p in pairs}]
        best = [c for c in counts if not any(o > c and (o[1] == c[1] or o[2] == c[2]) for o in counts)]
        return len(best) >= len({p[1] for p in pairs}) * rules.MIN_NAMES and sum(c[0] for c in best) >= len(pairs) * rules.MIN_NAMES

    split_items = {i: split(t) for i, t in items if t is not None}
    made = {i: windows(*s) for i, s in split_items.items() if s[0]}
    holders = {}
    for i, (ws, _) in made.items():
        raw, kinds = split_items[i]
        for p, span, literal in ws:
            holders.setdefault(tuple((raw if literal else kinds)[p : p + span]), set()).add(tuple(raw))
    out = {}
    for d, text in docs:
        raw, kinds = split(text)
        for i, (ws, n_windows) in made.items():
            ours, our_kinds = split_items[i]
            shifts, rare_met = {}, False
            few = {w: len(holders[tuple((ours if w[2] else our_kinds)[w[0] : w[0] + w[1]])]) <= rules.MAX_HOLDERS for w in ws}
            for p, span, literal in ws:
                for at in range(len(raw) - span + 1):
                    mine, theirs = (ours, raw) if literal else (our_kinds, kinds)
                    if mine[p : p + span] != theirs[at : at + span]:
                        continue
                    rare_met = rare_met or few[p, span, literal] or not any(few.values())
                    z = shifts.setdefault(at - p, (set(), set(), set(), set()))
                    z[0].update(range(p, p + span))
                    z[1].add(p)
                    if literal:
                        z[2].add(p)
                    else:
                        z[3].update((q, ours[q], raw[at + q - p]) for q in range(p, p + span) if our_kinds[q] == "<name>")
            reach = max(4, math.ceil(len(ours) / 4))
            ranges = {}
            for shift, z in shifts.items():
                for k in (0, 1):
                    ranges.setdefault((k, (shift + k * reach) // (2 * reach)), []).append(z)
            need = max(len(ours) * rules.MIN_SHARE, min(len(ours), rules.SHORT) * rules.SHORT_SHARE)
            for zs in ranges.values():
                matched = len(set().union(*[z[1] for z in zs]))
                if rare_met and len(set().union(*[z[0] for z in zs])) >= need and mapped([p for z in zs for p in z[3]]):
                    old = out.get((d, i), (n_windows, 0, False))
                    out[d, i] = (n_windows, max(old[1], matched), old[2] or max(len(z[2]) for z in zs) == n_windows)
    return out

"""Plain, slow versions of the operators' contracts, for small tables of rows."""

import base64
import hashlib
import json
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_quality(text):
    words = WORD.findall(text or "")
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in where.values() if len(places) > 1 for i in places for k in range(3)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    n, chars, symbols = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w)
    return n, chars, symbols, dups, len(covered), n < 50 or 100 * len(covered) > 50 * n


def quality(rows, *, share, least, most, depleted):
    """rows: (id, text, host) -> (id, removed lines, removed words, base failed, depleted, kept, cleaned text) for each row"""
    key = lambda line: re.sub("[0-9]", "0", " ".join(WORD.findall(line)).translate(LOWERED))
    name = lambda n, i: ("row", n) if i is None else i
    hosts, held = {}, {}
    for n, (i, text, host) in enumerate(rows):
        hosts.setdefault(host, set()).add(name(n, i))
        for line in (text or "").split("\n"):
            if WORD.search(line):
                held.setdefault((host, key(line)), set()).add(name(n, i))
    above = {k for k, ids in held.items() if len(ids) > least and (len(ids) > share * len(hosts[k[0]]) or len(ids) > most)}
    out = []
    for i, text, host in rows:
        lines = (text or "").split("\n")
        gone = {key(x) for x in lines if WORD.search(x) and (host, key(x)) in above and (i is None or i != min((h for h in held[host, key(x)] if isinstance(h, int)), default=None))}
        n, words = len(WORD.findall(text or "")), sum(len(WORD.findall(x)) for x in lines if key(x) in gone and WORD.search(x))
        failed, few = base_quality(text)[-1], n - words < depleted * n
        clean = "\n".join(x for x in lines if not (WORD.search(x) and key(x) in gone)) if gone else text
        out.append((i, len(gone), words, failed, few, not failed and not few, clean))
    return out


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWERED))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near(rows, width, percent=80):
    """rows: (id, text) -> {id: (size, component)}"""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def line_dedup(rows):
    """rows: (id, text) -> {id: (n_lines, n_dropped, text)}"""

    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r").translate(LOWERED)
        return k if len(k) >= 10 else None

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def contamination(rows, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWERED))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in rows:
        w = word.findall((t or "").translate(LOWERED))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (owners := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= owners
        out[i] = (len(w), len(hit), sorted(found))
    return out


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def base62(n):
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return "".join(digits[n // 62**k % 62] for k in range(5, -1, -1))


def added_secrets(text):
    """The spans beyond the contract's, by one expression for each kind over the whole text."""
    out = []
    for kind, pattern in (("forge", r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), ("registry", r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if base62(zlib.crc32(m[1].encode())) == m[2]]
    for m in re.finditer(r"(eyJ[\w-]+)\.[\w-]+\.[\w-]+", text, re.A):
        try:
            head = json.loads(base64.b64decode(m[1] + "===", altchars="-_"))
        except ValueError:
            continue
        if isinstance(head, dict) and isinstance(head.get("alg"), str):
            out.append(("jwt", m.start(), m.end()))
    for m in re.finditer(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/= \t\n\x0b\x0c\r]+)-----END \1-----", text):
        raw = base64.b64decode(m[2])
        short = raw[:1] == b"0" and raw[1] < 128 and len(raw) == 2 + raw[1]
        if short or raw[:2] == b"0\x81" and len(raw) == 3 + raw[2] or raw[:15] == b"openssh-key-v1\0":
            out.append(("pem", m.start(), m.end()))
    order = ["forge", "registry", "jwt", "pem"]
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def kd_tree(rows, n, ordinal, share):
    """rows: (id, size, text hash, id hash, codes) -> {id: shard}, hashes of the groups that are split"""
    groups = {}
    for i, size, text, by_id, codes in rows:
        groups.setdefault(text, []).append((i, size, by_id, codes))
    total = sum(r[1] for r in rows)
    sizes = {text: sum(m[1] for m in members) for text, members in groups.items()}
    large = [t for t in groups if sizes[t] > share * total / n or len(groups[t]) > share * len(rows) / n]
    out, loads, split = {}, [0] * n, set()
    for text in sorted(large, key=lambda t: (-sizes[t], t)):
        at = loads.index(min(loads))
        if loads[at] + sizes[text] > total / n:
            split.add(text)
            continue
        loads[at] += sizes[text]
        out.update({m[0]: at for m in groups[text]})
    units = []  # (sort key behind the value, size, codes, ids)
    for text, members in groups.items():
        least = [min(m[3][d] for m in members) for d in range(len(ordinal))]
        digits = [(text % 2**64) >> s & 4095 for s in (52, 40, 28)]
        parts = {}
        for i, size, by_id, _ in [] if text in large and text not in split else members:
            parts.setdefault(by_id % 4096 + 1 if text in split else 0, []).append((i, size))
        units += [((*digits, tie), sum(m[1] for m in own), least, [m[0] for m in own]) for tie, own in parts.items()]

    def width(values, d):
        return max(values) - min(values) if ordinal[d] else len(set(values)) - 1

    whole = [max(1, width([min(m[3][d] for m in members) for members in groups.values()], d)) for d in range(len(ordinal))]
    room = [total / n - load for load in loads]

    def place(own, leaves, first):
        if leaves == 1 or not own:
            out.update({i: first for u in own for i in u[3]})
            return
        widths = [width([u[2][d] for u in own], d) / whole[d] for d in range(len(ordinal))]
        along = widths.index(max(widths))
        all_room = sum(room[first : first + leaves])
        part = sum(room[first : first + leaves // 2]) / all_room if all_room else 0.5
        goal, upto, cells = sum(u[1] for u in own) * part, 0, {}
        for u in own:
            cells.setdefault((u[2][along], *u[0]), []).append(u)
        left, right = [], []
        for key in sorted(cells):
            inside = sum(u[1] for u in cells[key])
            takes = upto + inside < goal or upto < goal and 2 * (goal - upto) > inside
            (left if takes else right).extend(cells[key])
            upto += inside
        place(left, leaves // 2, first)
        place(right, leaves - leaves // 2, first + leaves // 2)

    place(units, n, 0)
    return out, split


def branch_levels(templates, z):
    """templates: {(host, path): (known, bad)} -> {(host, path): labels of each node on the path}; similar siblings are one node,
    and their subtrees are merged."""
    out = {t: [] for t in templates}

    def below(members, depth):
        children = {}
        for t in members:
            if len(t[1]) > depth:
                children.setdefault(t[1][depth], []).append(t)
        sums = {c: tuple(sum(templates[t][i] for t in own) for i in (0, 1)) for c, own in children.items()}
        known = sum(k for k, _ in sums.values())
        common = sum(b for _, b in sums.values()) / known if known else 0
        similar = [c for c, (k, b) in sums.items() if k and abs(b / k - common) <= z * (common * (1 - common) / k) ** 0.5]
        branches = [[c] for c in children if c not in similar] + ([similar] if similar else [])
        for branch in branches:
            own = [t for c in branch for t in children[c]]
            labels = tuple(sum(sums[c][i] for c in branch) for i in (0, 1))
            for t in own:
                out[t].append(labels)
            below(own, depth + 1)

    for host in {h for h, _ in templates}:
        below([t for t in templates if t[0] == host], 0)
    return out

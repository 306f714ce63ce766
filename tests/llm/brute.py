"""Plain Python versions of the contracts, for small inputs."""
import base64
import hashlib
import html.parser
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def op1(docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in docs:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha((t or "").encode())))
    return out


def op2_base(docs):
    out = []
    for i, t in docs:
        t = t or ""
        words = WORD.findall(t)
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        at = defaultdict(list)
        for k in range(len(words) - 2):
            at[tuple(words[k : k + 3])].append(k)
        covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
        n = len(words)
        out.append((i, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n))
    return out


def op3(pages):
    first = {}
    for i, h in pages:
        first[h or ""] = min(first.get(h or "", i), i)
    return [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
             "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, h in pages]


def op6(docs, bench, window=13):
    seqs = defaultdict(set)
    for item, t in bench:
        w = BENCH_WORD.findall((t or "").translate(LOW))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            seqs[tuple(w[k : k + n])].add(str(item))
    sizes = {len(s) for s in seqs}
    out = []
    for i, t in docs:
        w = BENCH_WORD.findall((t or "").translate(LOW))
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := seqs.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= got
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def op7(docs, window=20):
    first = {}
    out = []
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in first:
                gone.update(range(k, k + window))
            else:
                first[key] = (i, k)
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def op8(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role, text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        trained = "".join(t for _, r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(trained), sha(trained)))
    return out


def op9(docs, share=80):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for a, b in {p for v in holders.values() if len(v) > 1 for p in combinations(sorted(v), 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return [(i, len(s), root(i)) for i, s in sets.items()]


def op10_rows(docs):
    return [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs]


def counted(rows):
    return Counter(map(tuple, rows))


def cancelling_words(letters):
    """A word of a doubling pattern and its complement, which agree in any polynomial hash modulo a power of two."""
    word, swap = "a", str.maketrans("ab", "ba")
    while len(word) < letters:
        word += word.translate(swap)
    return word, word.translate(swap)


class _Tree(html.parser.HTMLParser):
    """A page of well-formed markup as nested lists [tag, classes, children]; text is a string among the children."""

    def __init__(self, page):
        super().__init__()
        self.top = ["", [], []]
        self.open = [self.top]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, (dict(attrs).get("class") or "").split(), []]
        self.open[-1][2].append(node)
        if tag != "br":
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


INLINE, NO_TEXT, NOT_CONTAINER = {"a", "b", "em", "span", "code", "math", "mi"}, {"script", "style", "title", "head"}, {"p", "h1", "h2", ""}
OUT_TAGS, OUT_CLASSES = {"nav", "footer", "aside", "form"}, {"ad", "comments", "share-buttons", "cookie-notice", "sidebar"}


def op5_blocks(page):
    """[(containers from outer to inner as (number, label), text, linked characters)] and the containers of level-one headings, in page order."""
    blocks, pieces, heads, count = [], [], [], [0]

    def flush(chain):
        text = " ".join("".join(s for s, _ in pieces).split())
        if text:
            blocks.append((chain, text, min(sum(len(s) for s, linked in pieces if linked), len(text))))
        pieces.clear()

    def walk(node, chain, linked, article):
        tag, classes, children = node
        if tag in NO_TEXT or tag in OUT_TAGS or tag == "header" and not article or tag not in ("header", "h1", "h2") and tag not in INLINE and OUT_CLASSES & set(classes):
            flush(chain)
            return
        if tag == "br" or tag not in INLINE:
            flush(chain)
        if tag == "h1":
            heads.append(chain)
        inner = chain
        if tag not in INLINE and tag not in NOT_CONTAINER and tag != "br":
            count[0] += 1
            label = ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in classes} - {""})])
            inner = (*chain, (count[0], label))
        for x in children:
            if isinstance(x, str):
                pieces.append((x, linked or tag == "a"))
            else:
                walk(x, inner, linked or tag == "a", article or tag in ("article", "main"))
        if tag not in INLINE:
            flush(inner)

    walk(_Tree(page).top, (), False, False)
    return blocks, heads


def op5_vote(blocks, heads):
    """The chain of containers that a page votes for, and its weight."""
    size = Counter()
    for chain, text, links in blocks:
        for k in range(len(chain) + 1):
            size[chain[:k]] += len(text) - links
    total = size[()]
    for name in ("article", "main"):
        good = [c for c in size if c and c[-1][1].split(".")[0] == name and 0 < total <= 2 * size[c]]
        if good:
            return min(good, key=lambda c: c[-1][0]), max(size[c] for c in good if c == min(good, key=lambda c: c[-1][0]))
    best = ()
    while True:
        inner = [c for c in size if len(c) == len(best) + 1 and c[: len(best)] == best]
        top = min(inner, key=lambda c: (-size[c], c[-1][0]), default=None)
        if top is None or not 0 < 0.8 * total <= size[top]:
            break
        best = top
    if heads:
        head = heads[0]
        while head != best[: len(head)]:
            head = head[:-1]
        best = head or best
    return best, size[best]


def op5(pages):
    """page_id, text of pages with hosts: votes, winners and second reading."""
    path = lambda chain: tuple(label for _, label in chain)
    read = [(i, host, *op5_blocks(page)) for i, host, page in pages]
    votes = defaultdict(Counter)
    for _, host, blocks, heads in read:
        chain, weight = op5_vote(blocks, heads)
        if weight > 0:
            votes[host][path(chain)] += weight
    out = []
    for i, host, blocks, heads in read:
        all_votes = sum(votes[host].values())
        winners = sorted((-n, len("".join("/" + x for x in p)), "".join("/" + x for x in p), p) for p, n in votes[host].items() if n >= 0.05 * all_votes)
        total = sum(len(t) - k for _, t, k in blocks)
        under = lambda p: [(t, k) for c, t, k in blocks if path(c)[: len(p)] == p]
        stands = lambda p: any(path(c)[: len(p)] == p for c, _, _ in blocks)
        chosen = next((p for *_, p in winners if stands(p) and sum(len(t) - k for t, k in under(p)) >= 0.5 * total), None)
        if chosen is None:
            chosen = path(op5_vote(blocks, heads)[0])
        out.append((i, "\n".join(t for t, _ in under(chosen))))
    return out


def url_parts(url):
    """(host, path) of a url; both empty without ://."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:end].translate(LOW), rest[end:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return host, rest[:end]


def rule_of(host, path, rules):
    fits = [(h + p, action) for action, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def op4(pages, docs, labels, rules, min_count=8, z=1.96, strength=10.0, max_bad=0.5, min_bad=3):
    """{page_id: (host, path, rule, verdict, template)} of pages (id, url, html)."""
    bad_of = defaultdict(list)
    texts = defaultdict(list)
    for i, quality in labels:
        if quality is not None:
            bad_of[i].append(int(quality == 0))
    for i, t in docs:
        if i in bad_of and WORD.search(t or ""):
            texts[" ".join(WORD.findall(t))] += bad_of[i]
    rows = []
    for i, url, page in pages:
        host, path = url_parts(url)
        rule, action = rule_of(host, path, rules)
        body = re.search(r"<article\b[^>]*>(.*?)(?:</article|\Z)", page or "", re.S)
        body = re.sub(r"<h1\b.*?</h1>", " ", body[1] if body else page or "", flags=re.S)
        words = " ".join(WORD.findall(html.unescape(re.sub(r"<[^>]*>", " ", body))))
        label = int(action == "block") if action else max(texts[words]) if texts.get(words) else None
        gpath = re.sub(r"(?<=/)(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{12,}(?=/|\Z)", "{x}", path)
        rows.append((i, host, path, rule, action, host, re.sub("[0-9]+", "{n}", gpath).split("/"), label))
    template = {k: "" for k in range(len(rows))}
    for d in range(1, max((len(r[6]) for r in rows), default=0)):
        groups = defaultdict(lambda: defaultdict(list))
        for k, r in enumerate(rows):
            if d < len(r[6]):
                groups[r[5], template[k]][r[6][d]].append(k)
        for branches in groups.values():
            known = [rows[k][7] for v in branches.values() for k in v if rows[k][7] is not None]
            for segment, members in branches.items():
                own = [rows[k][7] for k in members if rows[k][7] is not None]
                p = sum(known) / len(known) if known else 0
                literal = len(members) >= min_count and own and abs(sum(own) / len(own) - p) > z * (p * (1 - p) / len(own)) ** 0.5
                for k in members:
                    template[k] += "/" + (segment if literal else "*")
    known = [r[7] for r in rows if r[7] is not None]
    prior = min((sum(known) + 1) / (len(known) + 2), max_bad)
    pools = defaultdict(list)
    for k, r in enumerate(rows):
        pools[r[5], template[k]].append(r[7])
    rejected = {}
    for key, v in pools.items():
        own = [x for x in v if x is not None]
        rejected[key] = (sum(own) + strength * prior) / (len(own) + strength) > max_bad and sum(own) >= min_bad
    return [(i, host, path, rule, action or ("block" if rejected[host, template[k]] else "allow"), template[k]) for k, (i, host, path, rule, action, *_) in enumerate(rows)]


def op2_kept(rows, between=(0.1, 0.5), strength=20.0):
    """{doc_id: kept} of the judged rows, from their measures: bands, and verdicts by the defaults of the operator."""
    good = [r for r in rows if not r["base_failed"]]
    half_up = lambda x: int(abs(x) / 0.005 + 0.5) * (1 if x >= 0 else -1)

    def quartiles(values):
        bins = sorted(half_up(v) for v in values)
        return len(bins), *(bins[max(0, -(-int(4 * q * len(bins)) // 4) - 1)] * 0.005 for q in (0.25, 0.5, 0.75))

    bands = defaultdict(list)
    for r in good:
        bands[r["band"]].append(r)
    script = {b: r[0]["script"] for b, r in bands.items()}
    assert all(len({x["script"] for x in r}) == 1 for r in bands.values())

    def settle(measure, tokens, share=False, own_spread=True):
        own = {}
        for b, rs in bands.items():
            n, q1, q2, q3 = quartiles([r[measure] for r in rs])
            noise = spread = max((q3 - q1) / 1.349, 0.005)
            if own_spread:
                _, q1, _, q3 = quartiles([(r[measure] - q2) * r[tokens] ** 0.5 for r in rs])
                spread = max((q3 - q1) / 1.349, 0.005)
            own[b] = dict(total=n, centre=q2, noise=noise, spread=spread)
        mean = lambda c, of: sum(own[b]["total"] * own[b][c] for b in of) / sum(own[b]["total"] for b in of)
        out = {}
        for b, o in own.items():
            same = [x for x in own if script[x] == script[b]]
            n_script = sum(own[x]["total"] for x in same)
            lean = lambda n, c, wide: (n * c + strength * wide) / (n + strength)

            def draw(n, c, noise, wide, variance):
                w = (n - 1) / (n - 1 + noise * noise / variance)
                return w * c + (1 - w) * wide, (1 - w) * variance

            script_noise = lean(n_script, mean("noise", same), mean("noise", own))
            centre, var = draw(n_script, mean("centre", same), script_noise, mean("centre", own), (between[1] * (1 if share else mean("centre", own))) ** 2)
            centre, var = draw(o["total"], o["centre"], lean(o["total"], o["noise"], script_noise), centre, var + (between[0] * (1 if share else centre)) ** 2)
            out[b] = centre, var**0.5, lean(o["total"], o["spread"], lean(n_script, mean("spread", same), mean("spread", own)))
        return out

    chars, wide = settle("chars_per_token", "n_tokens"), settle("chars_per_wide_token", "n_wide_tokens")
    entropy, share = settle("token_entropy", "n_tokens", own_spread=False), settle("byte_share", "n_tokens", share=True)
    kept = {}
    for r in rows:
        fail = r["base_failed"]
        if r["band"] in bands and not fail:
            for bands_of, m, t, margin, width in ((chars, "chars_per_token", "n_tokens", 0.03, 4.0), (wide, "chars_per_wide_token", "n_wide_tokens", 0.01, 3.5)):
                c, unsure, spread = bands_of[r["band"]]
                fail |= abs(r[m] - c) > margin * c + width * (spread**2 / r[t] + unsure**2) ** 0.5
            c, unsure, spread = entropy[r["band"]]
            fail |= r["token_entropy"] < c - 5 * (spread**2 + unsure**2) ** 0.5
            c, unsure, spread = share[r["band"]]
            spread = max(spread, 3 * (c * max(1 - c, 0)) ** 0.5)
            fail |= r["byte_share"] > max(0.3, c * 1.03 + 4 * (spread**2 / r["n_tokens"] + unsure**2) ** 0.5)
        kept[r["doc_id"]] = not fail
    return kept


def op2_measures(text):
    """(tokens by the piece vocabulary, by the byte pairs, byte share, entropy) of a text."""
    import math

    import public_tokenizers as P
    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    pairs = tiktoken.Encoding("w", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = WORD.findall(text or "")
    ids = [t for w in words for t in pieces.encode(w)]
    counts = Counter(ids)
    return (len(ids), sum(len(pairs.encode_ordinary(" " + w)) for w in words), sum(map(pieces.is_byte, ids)) / max(len(ids), 1),
            -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values()))


def cut(texts, window=20):
    """{id: text} without the words that repeat earlier windows; texts that lose none stay as they are."""
    first, out = set(), {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in first:
                gone.update(range(k, k + window))
            first.add(key)
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else texts[i]
    return out


def op11_pieces(docs, capacity=4096):
    """(doc_id, piece, start, length, ids_crc32) by the public library on whole texts."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    out = []
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out.append((i, k // capacity, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    return out


def damaged(rows):
    """Rows (conv_id, turn, role, text) after op12's damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def op12(rows, convs):
    """Damaged rows and all conversation ids: forward over rows, keeping for each grammar state the least (cost, audit) and its turns."""
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role, text, turn))
    out = []
    for conv in convs:
        own = sorted(of[conv], key=lambda r: r[:4])
        seen, faults = set(), Counter()
        best = {"": (0, "", ())}
        step = {"": {"s": "s", "u": "su"}, "s": {"u": "su"}, "su": {"a": "sua"}, "sua": {"u": "su"}}

        def insert(best):
            best = dict(best)
            for _ in range(2):
                for state, (cost, audit, turns) in list(best.items()):
                    r = "user" if "u" in step[state] else "assistant"
                    made = (cost + 5, audit + "I", (*turns, (r, "")))
                    to = step[state][r[0]]
                    best[to] = min(best.get(to, made), made)
            return best

        for _, _, role, text, _ in own:
            blank, again = not WORD.search(text), (role, text) in seen
            cut = not blank and not again and WORD.findall(text)[-1][-1] not in ".!?"
            seen.add((role, text))
            faults["blank" if blank else "duplicate" if again else "truncated" if cut else ""] += 1
            nxt = {}
            for state, (cost, audit, turns) in insert(best).items():
                ways = [(state, cost + 2, "D", ())]
                if not blank and not again:
                    if role[:1] in step[state]:
                        ways.append((step[state][role[:1]], cost + 5 * cut, "K", ((role, text),)))
                    for r in ("user", "assistant"):
                        if r[0] in step[state]:
                            ways.append((step[state][r[0]], cost + 1 + 5 * cut, "R", ((r, text),)))
                for to, c, letter, more in ways:
                    made = (c, audit + letter, turns + more)
                    nxt[to] = min(nxt.get(to, made), made)
            best = nxt
        best = insert(best)
        cost, audit, turns = min(best[s] for s in ("", "sua") if s in best)
        numbers = {r[4] for r in own if r[4] is not None}
        letters = [r[2][:1] for r in own]
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults["blank"], faults["duplicate"], faults["truncated"],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False)), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in turns))))
    return out


def runs(words, least=24, times=3):
    """(start, length, period) of all runs, each lag compared word by word, and its stretch with every smaller lag."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stretch = words[s : i + q]
            if len(stretch) >= max(least, times * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((s, len(stretch), q))
    return sorted(out)


def op13(docs):
    out = []
    for i, text in docs:
        w = WORD.findall(text or "")
        n, h = len(w), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
        found = runs(w)
        gone = {x for s, m, q in found for x in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        out.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out

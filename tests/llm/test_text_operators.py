"""Each operator against brute force on a small table with all the odd cases, and on an empty one."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import crc


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def tokenizer(name):
    from voxmill.llm.bpe import load, tokenizer_path

    return load(tokenizer_path(name))


# -- sharding ---------------------------------------------------------------------------------


def best_capacity(sizes, shards):
    """Least capacity by trying all cuts."""
    pre = np.concatenate([[0], np.cumsum(sizes)])
    best = pre.copy().astype(float)
    for _ in range(shards - 1):
        best = np.array([min(max(best[i], pre[j] - pre[i]) for i in range(j + 1)) for j in range(len(pre))])
    return int(best[-1])


def test_sharding(docs, rows):
    from voxmill.llm.sharding import shard_documents

    for knots in (65_536, 16):
        got = shard_documents(docs, shards=12, knots=knots).collect()
        assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in got) == Counter((i, crc((t or "").encode()), len((t or "").encode()) + 16) for i, t in pairs(rows))
        groups = defaultdict(list)
        for i, t in pairs(rows):
            groups[t or ""].append(-1 if i is None else i)
        ids = {t: min((i for i in g if i >= 0), default=-1) for t, g in groups.items()}
        order = sorted(groups, key=lambda t: (ids[t], hashlib.sha256(t.encode()).digest()))
        sizes = [len(groups[t]) * (len(t.encode()) + 16) for t in order]
        load, where = Counter(), {}
        for r in got:
            load[r["shard"]] += r["size"]
            assert where.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
        assert max(load.values()) == best_capacity(sizes, 12)
        for s in load:
            slots = sorted(r["slot"] for r in got if r["shard"] == s)
            assert slots == list(range(len(slots)))
        in_order = [where[crc(t.encode())] for t in order]
        assert in_order == sorted(in_order)


def test_sharding_empty(no_docs):
    from voxmill.llm.sharding import shard_documents

    assert shard_documents(no_docs).collect() == []


# -- packing ----------------------------------------------------------------------------------


def test_packing(docs, rows):
    from voxmill.llm.packing import pack_documents

    tok = tokenizer("byte_bpe_50k.json")
    want = Counter()
    for i, t in pairs(rows):
        want[i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])] += 1
    got = pack_documents(docs, pool=64).collect()
    room, docs_seen = defaultdict(list), defaultdict(list)
    for p in got:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        room[p["sequence_id"]].append((p["offset"], p["length"]))
        docs_seen[p["doc_id"], p["doc_tokens"]].append((p["start"], ids))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    found = Counter()
    for (i, n), parts in docs_seen.items():
        copies, by_start = len([1 for s, _ in parts if s == 0]), sorted(parts)
        total = sum(len(x) for _, x in parts)
        assert total == copies * n
        whole = list(itertools.chain.from_iterable(x for _, x in by_start)) if copies == 1 else None
        found[i, tuple(whole) if whole else None] += copies
    for (i, ids), n in want.items():
        assert found[i, ids] == n or found[i, None] >= n
    tokens, sequences = sum(p["length"] for p in got), len(room)
    assert tokens >= 0.9 * 1024 * sequences


def test_balance_orders_by_cost():
    from voxmill.llm.packing import balance

    placed = balance(np.array([600, 500, 400, 300, 200]), 1024)
    load = Counter()
    for i, at, n, s in placed:
        load[s] += n
    assert sum(load.values()) == 2000 and max(load.values()) <= 1024 and set(load) == {0, 1}
    assert [p[3] for p in placed[:3]] == [0, 1, 1]  # the third goes to the cheaper one
    assert balance(np.zeros(0, int), 1024) == []


def test_packing_empty(no_docs):
    from voxmill.llm.packing import pack_documents

    assert pack_documents(no_docs).collect() == []


# -- token files and counts -------------------------------------------------------------------


def test_token_files(spark, docs, rows):
    from voxmill.llm.token_files import token_file_digest

    tok = tokenizer("byte_bpe_50k.json")
    order = sorted(pairs(rows), key=lambda r: (-1 if r[0] is None else r[0], tie(r[1] or "")))
    want, at = [], 0
    for i, t in order:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), crc(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_file_digest(docs, shard_docs=100, segment_tokens=5000).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_grammar_round_trip_and_random_access():
    from voxmill.llm.token_files import compress, decode_range, decompress, rule_lengths

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        ids = rng.integers(0, 6, n).astype(np.uint16)
        offsets = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 20)]))
        offsets = np.sort(np.concatenate([offsets, offsets[:1]]))  # with an empty document
        s, o, rules = compress(ids, offsets, 100)
        lengths = rule_lengths(rules, 100)
        back, at = decompress(s, o, rules, 100, lengths)
        assert (back == ids).all() and (at == offsets).all() and (n < 5000 or len(s) < 0.6 * n)
        for k in range(len(offsets) - 1):
            doc = ids[offsets[k] : offsets[k + 1]]
            assert (decompress(s, o, rules, 100, lengths, slice(k, k + 1))[0] == doc).all()
            for i, j in ((0, len(doc)), (3, 11), (len(doc) - 2, len(doc) + 5), (7, 7), (-4, 1)):
                assert (decode_range(s[o[k] : o[k + 1]], rules, 100, lengths, i, j) == doc[max(i, 0) : j]).all()


def test_single_documents_from_the_files(spark, tmp_path):
    from voxmill.llm.token_files import read_documents, write_token_files

    tok = tokenizer("byte_bpe_50k.json")
    texts = [f"text number {i} says the same thing again and again, " * (i % 40 + 1) for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "none"), (5, "a second fifth")], "doc_id long, text string")
    write_token_files(docs, f"{tmp_path}/f", shard_docs=50, segment_tokens=4000)
    ids = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
    got = {(r["doc_id"], r["n_tokens"], r["ids"]) for r in read_documents(spark, f"{tmp_path}/f", [5, 39, 299, 777]).collect()}
    assert got == {(i, len(x), bytes(x.tobytes())) for i, x in [(5, ids(texts[5])), (5, ids("a second fifth")), (39, ids(texts[39])), (299, ids(texts[299]))]}
    (part,) = read_documents(spark, f"{tmp_path}/f", [39], 100, 120).collect()
    assert part["ids"] == ids(texts[39])[100:120].tobytes()


def test_token_files_empty(no_docs):
    from voxmill.llm.token_files import token_file_digest

    assert token_file_digest(no_docs).collect() == []


def test_token_counts(docs, rows):
    from voxmill.llm.token_counts import count_tokens

    tok = tokenizer("word_bpe_49k.json")
    want = Counter()
    for i, t in pairs(rows):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 2048] += 1
    assert Counter(map(tuple, count_tokens(docs, most=50).collect())) == want


def test_token_counts_empty(no_docs):
    from voxmill.llm.token_counts import count_tokens

    assert count_tokens(no_docs).collect() == []


def test_encoders_match_the_library_on_odd_texts():
    import random

    import pyarrow as pa

    from voxmill.llm.bpe import ByteBpe, Limits, WordCounter, tokenizer_path

    rng = random.Random(3)
    alphabet = "ab 'sé\n.1_9\t²́ \u00a0\u2003\u2014 !A<|>σΣЖ×\r\x0b\x1c\u0338=İ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(6000)] + ["foo <|endoftext|> bar", "", "日本語 テスト", "İ ǅ ſ", "İ#", " \n x", "it's 'll'sx  \n\n y ", "\n"]
    array = pa.array(["cut off", *texts, None])[1:]
    b, w = ByteBpe(tokenizer_path("byte_bpe_50k.json"), Limits(50, 50)), WordCounter(tokenizer_path("word_bpe_49k.json"), (["ab"], [1]), Limits(50, 8))
    ids, at = b.encode(array)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [e.ids for e in b.tok.encode_batch([*texts, ""], add_special_tokens=False)]
    assert w.count(array).tolist() == [len(e) for e in w.tok.encode_batch([*texts, ""], add_special_tokens=False)]


# -- personal data ----------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out)), Counter(k for _, _, k, _ in out)


@pytest.fixture(scope="module")
def private(spark):
    texts = [
        "mail bob@x.org, ip 1.2.3.4 and 300.1.1.1 or 01.002.3.255.7.8.9.10", "card 4111 1111-1111 1111 no 4111111111111112 yes 4532015112830366", "call +1 (555) 123-4567 or +49.30.1234 or +1  2", "é😀 a@b.c@d.e a@b.c_x@y.z @ . a@b",
        "4111111111111111 +14155552671 10.0.0.1@host.example.com", "1" * 5000, "a" * 5000 + "@" + "b.c" * 2000, "x.y@" + "-.-" * 10, "", None, "12 34 5 6 7 8 9 0 1 2 3 4 5 6", "+1 (988) 555-2485 +1 (988) 555-24", "0 0 0 0 0 0 0 0 0 0 0 0",
    ]
    import random

    rng = random.Random(1)
    texts += ["".join(rng.choice("1234@.+-( )a é") for _ in range(rng.randint(5, 60))) for _ in range(400)]
    # a context that always holds an address, and once one that the base kind misses
    texts += [f"server address is 10.1.{i}.7 today" for i in range(40)] + ["server address is fe80:0:0:0:1:2:3:4 today", "server address is down123 today"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), texts


def test_personal_data(private):
    from voxmill.llm.pii import find_personal_data, span_digest

    df, texts = private
    got = {r["doc_id"]: r for r in span_digest(find_personal_data(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        joined, counts = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (t, got[i], joined)
        assert [got[i][f"n_{k}"] for k in BASE] == [counts[k] for k in BASE]
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))
    assert got[len(texts) - 2]["spans"] == "ip:18:36"  # its context says so
    assert got[len(texts) - 1]["spans"] == ""  # a word that can be no address


def test_masking(private):
    from voxmill.llm.pii import masked_documents

    df, texts = private
    got = {r["doc_id"]: r["text"] for r in masked_documents(df).collect()}
    assert got[0].startswith("mail [email], ip [ip] and 300.1.1.1 or [ip].[ip]") and got[8] == "" and got[9] is None
    assert got[len(texts) - 2] == "server address is [ip] today" and len(got) == len(texts)


def test_identifiers_of_several_words_and_glued_cues(spark):
    from voxmill.llm.pii import find_personal_data, masked_documents, span_digest

    cards = [c for c in (str(4532015112830000 + i) for i in range(600)) if luhn(c)]
    texts = [f"please call +1 (555) 123-{1000 + i} now" for i in range(40)] + [f"reach tel:+1555123{1000 + i} now" for i in range(40)]
    texts += [f"pay with card {c} now" for c in cards[:40]] + [f"pay with card={c} now" for c in cards[:40]]
    texts += [f"reach mail:bob{i}@x.org now" for i in range(40)]
    new = {
        "please call (555) 123-4567 now": ("phone:12:26", "please call [phone] now"),
        "please call 555 123 4567 now": ("phone:12:24", "please call [phone] now"),
        "please call 555.123.4567, now": ("phone:12:24", "please call [phone], now"),
        "pay with card 4111 1111 1111 1112 now": ("card:14:33", "pay with card [card] now"),
        "reach tel:5551234567 now": ("phone:10:20", "reach tel:[phone] now"),
        "reach tel:(555) 123-4567 now": ("phone:10:24", "reach tel:[phone] now"),
        "pay with card=4111111111111112 now": ("card:14:30", "pay with card=[card] now"),
        "reach mail:bob@localhost now": ("email:11:24", "reach mail:[email] now"),
        "sold 555 123 4567 and (555) 123-4567 pieces": ("", "sold 555 123 4567 and (555) 123-4567 pieces"),
        "please call 12 times, now": ("", "please call 12 times, now"),
        "please call 555 123 4567 8th street": ("phone:12:24", "please call [phone] 8th street"),
        "(1) " * 20_000 + "1 " * 50_000 + "x1.2" * 20_000 + "z": (None, None),
    }
    df = spark.createDataFrame(list(enumerate(texts + list(new))), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in span_digest(find_personal_data(df)).collect()}
    masked = {r["doc_id"]: r["text"] for r in masked_documents(df).collect()}
    for i, (t, (span, text)) in enumerate(new.items(), len(texts)):
        if text is not None:
            assert (spans[i], masked[i]) == (span, text), t


def by_hand(texts, rounds=3, confidence=0.8, support=5):
    """Discovered spans by loops over words, patterns and instances."""
    import math

    import regex

    ws, spots = r"[\x20\x09-\x0D]+", []
    cue = regex.compile(r"^[^0-9@:=]*[:=][\"'(\[]*(?!/)")
    run = regex.compile(r"(?<![\p{L}0-9_@%./+-])\+?+(?:\((?=[0-9]{1,5}\)))?+[0-9]++(?![\p{L}_@%])(?:[ ().-]++[0-9]++(?![\p{L}_@%]))*+")
    number = lambda v: sum(map(str.isdigit, v))

    def patterns(before, after):
        norm = lambda w: re.sub("[0-9]", "0", w.lower())
        words, nxt = [norm(w) for w in re.split(ws, before[-80:].rstrip(" "))], norm(re.split(ws, after[:40].lstrip(" "))[0])
        one, two = words[-1], words[-2] if len(words) > 1 else ""
        return f"1 {one}", f"2 {two} {one}", f"3 {one} _ {nxt}"

    for doc, t in enumerate(texts):
        base = [(int(s), int(e), list(BASE).index(k)) for k, s, e in (x.split(":") for x in base_spans(t)[0].split(",") if x)]
        found = [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if len(m[0]) >= 6 and re.search("[0-9@]", m[0])]
        for s, v in list(found):
            w = cue.sub("", v)
            if w != v and len(w) >= 6 and re.search("[0-9@]", w):
                found.append((s + len(v) - len(w), w))
        found += [(m.start(), m[0]) for m in run.finditer(t) if number(m[0]) >= 7]
        found = [(s, v) for s, v in found if not any(a < s + len(v) and s < b for a, b, _ in base)]
        found = {(s, re.sub(r"[.,;:!?\"')\]}>]+$", "", v)) for s, v in found}
        spots += [(doc, s, e, k, t[s:e].lower(), patterns(t[:s], t[e:])) for s, e, k in base]
        spots += [(doc, s, s + len(v), -1, v.lower(), patterns(t[:s], t[s + len(v) :])) for s, v in found if v]
    edges = {}
    for *_, k, v, ps in spots:
        for p in ps:
            edges[p, v] = max(k, edges.get((p, v), -1))
    n = Counter(p for p, _ in edges)
    seeds = Counter(p for (p, _), k in edges.items() if k >= 0)
    graph = {(p, v): k for (p, v), k in edges.items() if seeds[p] >= support}
    fresh = {}
    for r in range(rounds):
        total, sure = defaultdict(float), Counter()
        for (p, v), k in graph.items():
            for kind, score in [(k, 1.0)] if k >= 0 else [(kind, x) for (w, kind), x in fresh.items() if w == v]:
                total[p, kind] += score
                sure[p, kind] += score == 1.0
        conf = {key: x / (n[key[0]] + 1) for key, x in total.items()}
        if r + 1 < rounds:
            miss = defaultdict(float)
            for (p, v), k in graph.items():
                for (q, kind), c in conf.items() if k < 0 else ():
                    if q == p and c >= 0.5:
                        miss[v, kind] += math.log(1 - min(c, 0.999))
            fresh = {key: 1 - math.exp(x) for key, x in miss.items() if 1 - math.exp(x) < 1}
    fits = (
        lambda v: re.fullmatch(r"[^@]+@[^@]+", v),
        lambda v: re.fullmatch(r"[0-9a-f]{1,4}([.:][0-9a-f]{0,4}){3,7}", v),
        lambda v: not re.sub("[0-9 ().+-]", "", v) and 12 <= number(v) <= 19,
        lambda v: not re.sub("[0-9 ().+-]", "", v) and 7 <= number(v) <= 15,
    )
    strong = defaultdict(list)
    for (p, v), k in graph.items():
        for (q, kind), c in conf.items() if k < 0 else ():
            if q == p and c >= confidence and sure[q, kind] >= support and fits[kind](v):
                strong[v].append((c, -kind, p))
    out = set()
    for doc, s, e, k, v, ps in spots:
        if k < 0 and any(p in ps for _, _, p in strong[v]):
            out.add((doc, s, e, -max(strong[v])[1]))
    return out


def test_discovery_by_hand(spark):
    import random

    from voxmill.llm.pii import find_personal_data

    rng, cards = random.Random(8), [c for c in (str(4532015112830000 + i) for i in range(900)) if luhn(c)]
    cues = ["call", "call me at", "card", "my card:", "server", "from host", "mail", "write to", "number", "order"]
    texts = []
    for i in range(500):
        parts = []
        for _ in range(rng.randint(1, 4)):
            what = rng.choice([f"+1 555 123 {1000 + i}", f"+1 (555) 123-{1000 + i}", cards[i % 60], f"10.0.{i % 250}.{rng.randint(0, 300)}", f"bob{i}@x.org", f"555-123-{1000 + i}", f"4111 1111 1111 {1000 + i}", f"é{i}@localhost", f"tel:555{1000000 + i}", f"card={cards[i % 50]}", f"fe80:0:{i % 9}:1", "(12)", f"item{i:06d},"])
            parts.append(rng.choice(cues) + " " + what + rng.choice(["", ".", ",", " now", "\nthen", "  thanks"]))
        texts.append(" and ".join(parts))
    got = {(r["doc_id"], x["s"], x["e"], x["k"]) for r in find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), confidence=0.3, support=3).collect() for x in r["spans"] if x not in r["base"]}
    want = by_hand(texts, confidence=0.3, support=3)
    assert len(want) >= 20 and got == want


def test_a_long_text_full_of_identifiers(spark):
    """A long text full of identifiers, in more than one chunk of each kind."""
    from voxmill.llm.pii import find_personal_data, masked_documents

    part = "server 10.1.2.3 mail bob@x.org or call +1 (555) 123-4567 about order 4711-0815-99 é now\n"
    df = spark.createDataFrame([(1, part * 4000), (2, part)], "doc_id long, text string")
    sizes = {r["doc_id"]: len(r["base"]) for r in find_personal_data(df).select("doc_id", "base").collect()}
    assert sizes == {1: 12_000, 2: 3}
    texts = {r["doc_id"]: r["text"] for r in masked_documents(df).collect()}
    assert texts[1] == texts[2] * 4000 and texts[2].startswith("server [ip] mail [email] or call [phone] about")


def test_personal_data_empty(no_docs, docs, rows):
    from voxmill.llm.pii import find_personal_data, masked_documents, span_digest

    assert find_personal_data(no_docs).collect() == []
    assert span_digest(find_personal_data(docs)).count() == len(rows)
    out = masked_documents(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


# -- quality ----------------------------------------------------------------------------------


def measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, dup, known = text.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in known
            known.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality(spark, docs, rows):
    from voxmill.llm.quality import apply_quality

    got = apply_quality(docs).collect()
    want = Counter((i, *measure(t or "")) for i, t in pairs(rows))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_bad_hosts_take_their_documents_along(spark):
    from voxmill.llm.quality import apply_quality

    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad", None, "spam", 0) for i in range(60)] + [(100, good, None, "spam", 0)] + [(200 + i, good, None, f"h{i % 9}", 0) for i in range(180)] + [(500, "bad", None, "h1", 0), (501, "bad", None, "lone", 0), (502, good, None, None, 0)]
    got = {r["doc_id"]: r["kept"] for r in apply_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not got[100] and all(got[200 + i] for i in range(180)) and not got[500] and got[502]


def test_quality_empty(no_docs):
    from voxmill.llm.quality import apply_quality

    assert apply_quality(no_docs).collect() == []


# -- mixing -----------------------------------------------------------------------------------


def fair_targets(sizes, weights, most=3.0):
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest, w = total - sum(out[i] for i in range(len(sizes)) if i not in free), sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / w > most * sizes[i]]
        for i in over or free:
            out[i] = most * sizes[i] if over else rest * weights[i] / w
        if not over:
            break
        free -= set(over)
    return out


def tie(text):
    """Spark's xxhash64 of a text."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) * (h >> 63)


def test_mixing(docs, rows):
    from voxmill.llm.mixing import taken_words

    got = taken_words(docs, shards=8).collect()
    again = taken_words(docs, shards=8).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, fair_targets([size[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    source = {(r[0], len((r[1] or "").split())): r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(targets[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - targets[s]) <= 64 + 0.01 * targets[s]


def test_mixture_by_hand(docs, rows):
    """Draws, slots, blocks and words one by one, with several groups of sources."""
    from voxmill.llm.mixing import _key, draw_counts, permute, shard_sizes, taken_words

    block, shards, group, seed = 8, 5, 2, 20
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    of = [sorted((r for r in rows if r[3] == n), key=lambda r: (-1 if r[0] is None else r[0], tie(r[1]), len((r[1] or "").split()))) for n in names]
    words = [[i for i, r in enumerate(own) for _ in (r[1] or "").split()] for own in of]
    targets = fair_targets(list(map(len, words)), [(5, 2, 1)[i % 3] for i in range(len(names))])
    blocks = [-(-len(w) // block) for w in words]
    quotas = [min(3 * b, int(t * b / len(w) + 0.5)) if w else 0 for w, t, b in zip(words, targets, blocks)]
    groups = [quotas[i : i + group] for i in range(0, len(quotas), group)]
    sizes = draw_counts([sum(g) for g in groups], shard_sizes(sum(quotas), shards), seed)
    want = Counter()
    for g, own in enumerate(groups):
        draws = draw_counts(own, sizes[:, g], seed + 1 + g)
        for i in range(len(own)):
            src, slot, times = g * group + i, 0, Counter()
            for k in range(shards):
                for _ in range(draws[k, i]):
                    n, one = blocks[src], lambda v: np.array([v])
                    times[int(permute(one(slot % n), one(n), _key(seed, one(src), one(slot // n)))[0])] += 1
                    slot += 1
            assert sum(times.values()) == quotas[src]
            taken = Counter()
            for place, doc in enumerate(words[src]):
                taken[doc] += times[place // block]
            for doc, r in enumerate(of[src]):
                want[r[0], len((r[1] or "").split()), len(words[src]), taken[doc]] += 1
    got = taken_words(docs, block=block, shards=shards, group=group, seed=seed).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got) == want


def test_targets_stop_at_three_times_a_source(spark):
    from pyspark.sql import functions as F

    from voxmill.llm.mixing import level

    assert fair_targets([1, 1, 98], [5, 2, 1]) == pytest.approx([3, 3, 94])
    for sizes, weights in (([10, 100, 100], [5, 2, 1]), ([0, 5], [5, 1]), ([1, 1, 98], [5, 2, 1]), ([7], [5]), ([0, 0], [5, 2]), ([3, 1000, 2, 500, 80, 9], [5, 2, 1, 5, 2, 1])):
        x = level(spark.createDataFrame(list(zip(sizes, map(float, weights))), "size long, w double"), F.col("w"))
        assert [min(3 * n, x * w) for n, w in zip(sizes, weights)] == pytest.approx(fair_targets(sizes, weights))


def test_permutations_are_bijections():
    from voxmill.llm.mixing import draw_counts, permute, shard_sizes

    for n in (1, 2, 3, 7, 64, 1000):
        p = permute(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(p.tolist()) == list(range(n))
    a, b = (permute(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (1, 2))
    assert (a != b).mean() > 0.9
    d = draw_counts([100, 0, 7, 1000], shard_sizes(1107, 16), 3)
    assert d.sum(0).tolist() == [100, 0, 7, 1000] and (d >= 0).all() and d.sum(1).max() - d.sum(1).min() <= 1


def test_mixed_texts_have_the_words_taken(docs, rows):
    from voxmill.llm.mixing import mixed_documents, taken_words

    out = mixed_documents(docs, shards=8)
    assert out.columns == docs.columns
    words = sum(len(r["text"].split()) for r in out.select("text").collect())
    assert words == sum(r["taken"] for r in taken_words(docs, shards=8).collect())


def test_mixing_empty(no_docs):
    from voxmill.llm.mixing import mixed_documents, taken_words

    assert taken_words(no_docs).collect() == [] and mixed_documents(no_docs).collect() == []


# -- language ---------------------------------------------------------------------------------


def test_language(docs, rows):
    from voxmill.llm.langid import identify

    got = identify(docs).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 240 and r[0] != 7 and r[0] != 8}
    held = [(r["lang_pred"], lang[r["doc_id"]]) for r in got if r["doc_id"] in lang and r["held_out"]]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.95 * len(held)
    for r in got:
        assert r["held_out"] == (crc(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["doc_id"] in (500, 501, 502, 504):
            assert r["lang_pred"] == "und"
        if r["doc_id"] in (503, 507):
            assert r["lang_pred"] != "und"


def test_language_by_hand(docs, rows):
    """Kernels from sets of n-grams, the Nystrom map and the regression spelled out."""
    from voxmill.llm.langid import identify

    def ngrams(text):
        out = bytearray(b" ")
        for a, b in zip(b" " + text.encode(), text.encode() + b" "):
            c = b + 32 if a == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97 else b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 else 32
            if not (c == 32 and out[-1] == 32):
                out.append(c)
        return {bytes(out[i : i + n]) for n in (1, 2, 3) for i in range(len(out) - n + 1)}

    def order(r):
        h = xxhash.xxh64_intdigest(np.array([r[0]], "<i8").tobytes(), 42) if r[0] is not None else 42
        return r[2], h & (2**63 - 1), -1 if r[0] is None else r[0], tie(r[1])

    train = sorted((r for r in rows if r[1] is not None and r[2] is not None and crc(str("" if r[0] is None else r[0]).encode()) % 5), key=order)
    sets, names = [ngrams(r[1]) for r in train], sorted({r[2] for r in train})
    shared = Counter(g for s in sets for g in s)
    spectrum = set(sorted(shared, key=lambda g: (-shared[g], len(g), g))[:800])
    sets = [s & spectrum for s in sets]
    turn, seen = [], Counter()
    for i, r in enumerate(train):
        turn.append((seen[r[2]], r[2], i))
        seen[r[2]] += 1
    marks = [sets[i] for _, _, i in sorted(turn)[:40]]
    kernel = lambda a, b: len(a & b) / max(1, len(a) * len(b)) ** 0.5
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
    phi = lambda s: np.append(np.array([kernel(s, m) for m in marks]) @ root, 1.0)
    x, y = np.array([phi(s) for s in sets]), np.array([[1.0 if r[2] == n else -1.0 for n in names] for r in train])
    w = np.array([1 / seen[r[2]] for r in train])[:, None]
    beta = np.linalg.solve((x * w).T @ x + 1e-3 * np.eye(x.shape[1]), (x * w).T @ y)
    want = defaultdict(list)
    for r in rows:
        f = phi(ngrams(r[1] or "") & spectrum) @ beta
        known = any(map(str.isalpha, r[1] or ""))
        want[r[0]].append((names[int(f.argmax())] if known else "und", (np.exp(4 * (f - f.max())) / np.exp(4 * (f - f.max())).sum()).max() if known else 0.0))
    got = defaultdict(list)
    for r in identify(docs, per_label=1000, landmarks=40, spectrum=800).collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert set(got) == set(want)
    for i in want:
        for (a, p), (b, q) in zip(sorted(got[i]), sorted(want[i])):
            assert a == b and p == pytest.approx(q, abs=2e-3)


def test_language_empty_or_unlabelled(no_docs, spark):
    from voxmill.llm.langid import identify

    assert identify(no_docs).collect() == []
    got = identify(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert [r["lang_pred"] for r in got] == ["und"]


# -- SimHash ----------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in linked:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_simhash(docs, rows):
    from voxmill.llm.simhash import near_duplicates

    got = near_duplicates(docs).collect()
    prints = [plain_fingerprint(t or "") for _, t in pairs(rows)]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{p:016x}") for (i, _), p in zip(pairs(rows), prints))
    roots = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    least = {}
    for r, (i, _) in zip(roots, pairs(rows)):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((i, least.get(r)) for r, (i, _) in zip(roots, pairs(rows)))


@pytest.mark.parametrize("tile", [4096, 40])
def test_links_of_planted_fingerprints(spark, tile):
    """Chains and clusters at distances up to and over the radius, with and without tiles."""
    from voxmill.llm._common import connected_components
    from voxmill.llm.simhash import link_fingerprints

    rng = np.random.default_rng(4)
    prints = set(int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    for p in list(prints)[:40]:
        q = p
        for _ in range(8):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                q ^= 1 << int(b)
            prints.add(q)
    prints |= {(0xABCDEF << 40) ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(link_fingerprints(df, tile)).collect()}
    roots = components(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    groups, mine = defaultdict(set), defaultdict(set)
    for s, r in zip(signed, roots):
        groups[r].add(s)
        mine[got.get(s, s)].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_simhash_representatives(docs, no_docs, rows):
    from voxmill.llm.simhash import near_duplicate_representatives, near_duplicates

    out = near_duplicate_representatives(docs)
    kept = out.collect()
    prints = [plain_fingerprint(t or "") for _, t in pairs(rows)]
    roots = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert out.columns == docs.columns and len(kept) == len(set(roots))
    assert near_duplicate_representatives(no_docs).collect() == [] and near_duplicates(no_docs).collect() == []


def test_repair_goes_on_until_no_pair_is_frequent():
    import numpy as np

    from voxmill.llm.token_files import compress, decompress, rule_lengths

    ids = np.concatenate([np.tile(np.random.default_rng(1).integers(0, 500, 300), 400), np.arange(100), np.tile(np.arange(7), 500)])
    offsets = np.array([0, 120_000, 120_100, len(ids)])
    symbols, cuts, rules = compress(ids, offsets, 500)
    assert len(symbols) < len(ids) / 200  # six doublings leave a 64th at best
    inside = np.ones(len(symbols) - 1, bool)
    inside[cuts[1:-1] - 1] = False
    assert max(Counter(zip(symbols[:-1][inside].tolist(), symbols[1:][inside].tolist())).values()) < 8
    lengths = rule_lengths(rules, 500)
    got, ends = decompress(symbols, cuts, rules, 500, lengths)
    assert (got == ids).all() and (ends == offsets).all()
    for i in range(3):
        assert (decompress(symbols, cuts, rules, 500, lengths, slice(i, i + 1))[0] == ids[offsets[i] : offsets[i + 1]]).all()

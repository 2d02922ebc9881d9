"""The operators for training data against brute-force versions, on rows with nulls, empty texts, ties, repeats and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from streamatlas.llm import chat, decontaminate, minhash_dedup, packing, pii, quality, substring_dedup, suffix_dedup, token_files, toxicity
from streamatlas.llm.queries import tokenizer_file

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, part int, n int, key string, `row` int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghié") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    write = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [write(120) for _ in range(12)]
    texts = [None, "", "  \n\t", "one two", *base, base[0], base[1].replace(" ", "  ", 3), base[2] + " tail words", write(20) + " " + base[3] + "\n" + write(9), write(3000)]
    edited = base[4].split()
    edited[60] = "changed"
    return [(k, t) for k, t in enumerate([*texts, " ".join(edited)])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "x", 3) for d, t in rows], SCHEMA)


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    folder, index = token_files.encode_to_files(docs, path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in index.collect()}
    start = 0
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_token_files(spark, folder).where("doc_id = 5").count() == 1


def test_packing(docs, rows):
    found = packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), capacity=64).toPandas()
    assert set(found.doc_id) == {d for d, _ in rows}
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= 64 and own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    assert found.sequence_id.nunique() <= max(found.length.sum() / 64, (found.length > 32).sum()) + 2


def test_substring_dedup(docs, rows):
    first, words = {}, {}
    for d, t in rows:
        words[d] = WORDS.findall(t or "")
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    want = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        want[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()} == want


def test_suffix_dedup(docs, rows):
    texts = {d: (t or "").encode() for d, t in rows}
    count = Counter(b[i : i + 400] for b in texts.values() for i in range(len(b) - 399))
    want = {}
    for d, b in texts.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_bytes(docs).collect()} == want


def test_near_duplicates(docs, rows):
    sets = {}
    for d, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {d: (len(sets[d]), root[d], root[d] == d) for d in sets}


def test_quality(docs, rows):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for d, t in rows:
        w = WORDS.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        count, seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
        for i in range(len(w) - 2):
            if count[tuple(w[i : i + 3])] > 1:
                seen.update((i, i + 1, i + 2))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(seen))
        assert r.base_failed == (len(w) < 50 or 2 * len(seen) > len(w))
    assert {r.policy for r in quality.ablations(quality.ledger(docs)).collect()} == set(quality.POLICIES)


def test_personal_data(spark):
    texts = ["write to Ann.Lee@example.org now", "at 10.0.0.256 or 10.0.0.25", "card 4111 1111 1111 1111.", "call +44 (20) 7946-0958", None, "", "no data"]
    found = pii.span_digest(pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    got = {r.doc_id: r.spans for r in found.collect()}
    assert got == {0: "email:9:28", 1: "ip:17:26", 2: "card:5:24", 3: "phone:5:23", 4: "", 5: "", 6: ""}


def test_terms_that_disclose(spark):
    rng = random.Random(1)
    common = ["alpha", "gamma", "delta", "kappa", "sigma", "omega"]
    rows = [(k, " ".join(rng.choice(common) for _ in range(9))) for k in range(60)]
    rows += [(100 + k, f"alpha zorblat ann@example.org gamma number {k}") for k in range(4)]
    clean = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert "zorblat" not in texts[101] and "alpha" in texts[101] and "[EMAIL]" in texts[101]
    assert all(texts[k] == t for k, t in rows if k < 100)


def _assert_telling(texts, got, others=lambda t: set()):
    """The terms found are those of counts in plain Python."""
    holds = [{w.lower() for w in re.findall(r"[^\W_]+", t)} for t in texts]
    values = [others(t) | {("email", e) for e in re.findall(r"\w+@example\.org", t)} for t in texts]
    n_term, n_value = Counter(w for h in holds for w in h), Counter(v for x in values for v in x)
    n_both = Counter((v, w) for x, h in zip(values, holds) for v in x for w in h)
    for k, text in enumerate(texts):
        want = set()
        for v in values[k]:
            p = n_value[v] / len(texts)
            want |= {w for w in holds[k] if np.log2((n_both[v, w] + p) / (n_term[w] + 1) / p) >= 0.9 * -np.log2(p)}
        base = [(s.start, s.end) for s in got[k] if s.kind < 4]
        places = {m.span() for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in want and not any(a < m.end() and m.start() < b for a, b in base)}
        assert {(s.start, s.end) for s in got[k] if s.kind == 4} == places, k


def test_terms_that_disclose_a_value_of_few_documents(spark):
    """Against counts in plain Python: values of one or two documents, terms far from them and short ones."""
    rng = random.Random(11)
    common = [f"w{a}{b}" for a in "abcdefghij" for b in "klmno"]
    write = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [write(12) for _ in range(3000)]
    texts[7] = f"Lee {write(40)} ann@example.org {write(30)} zorblat"
    texts[8] = f"Kim \u674e {write(20)} +44 20 7946 0958 and bob@example.org"
    texts[9] = f"{write(20)} bob@example.org {write(20)} Kim"
    texts[10] = f"Lee {write(9)} lee"
    texts[11] = texts[12] = f"zorblat {write(9)}"
    got = {r.doc_id: r.found for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    _assert_telling(texts, got, lambda t: {("phone", "442079460958")} if "+44" in t else set())
    said = lambda k: {texts[k][s.start : s.end] for s in got[k] if s.kind == 4}
    assert {"Kim", "\u674e"} <= said(8) and said(9) == {"Kim"} and "Lee" not in said(7) | said(10)


def test_address_lists_stay_linear(spark, monkeypatch):
    """Values of one to six documents, lists of addresses, one of them copied: the terms are right, and pairs are only made where two rows must agree."""
    rng = random.Random(5)
    common, rare = [f"w{a}{b}" for a in "abcdefghij" for b in "klmno"], [f"z{k}" for k in range(60)]
    write = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [write(12) for _ in range(2500)]
    for k in range(20, 80):
        texts[k] = f"{write(8)} {' '.join(rng.sample(rare, 3))} u{rng.randint(0, 15)}@example.org {write(4)} v{rng.randint(0, 40)}@example.org"
    texts[0] = " ".join(f"name{k} one{k}@example.org" for k in range(400))
    texts[1] = texts[2] = " ".join(f"other{k} two{k}@example.org" for k in range(250))
    sizes, plain = {}, pii.materialise

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(pii, "materialise", counted)
    found = pii.find_personal_data(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4))
    got = {r.doc_id: r.found for r in found.collect()}
    assert sizes["candidates"] <= sizes["rare-terms"] + 2000 < 8000
    _assert_telling(texts, got)


def test_passages(spark):
    rng = random.Random(2)
    write = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(k, write(30)) for k in range(20)] + [(90, "short item"), (91, ""), (92, None)]
    docs, want = [(900, None), (901, ""), (902, write(300))], set()
    for k, text in items[:20]:
        edited = text[:50] + "x" + text[51:120] + text[122:]
        docs += [(k, f"{write(40)} {text.upper()} {write(5)}"), (100 + k, f"{write(8)} {edited} {write(40)}")]
        want |= {(k, k), (100 + k, k)}
    docs.append((500, "a SHORT item here"))
    found = decontaminate.benchmark_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= want | {(500, 90)} and len(got) >= 0.9 * (len(want) + 1)


def _passages(spark, docs, items):
    found = decontaminate.benchmark_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r.distance for r in found.collect()}


def test_passages_glued_or_without_blanks(spark):
    rng = random.Random(12)
    write = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    han = [chr(c) for c in range(0x4E00, 0x5200)]
    items = [(k, " ".join(write("abcdefghijklmnop", rng.randint(2, 8)) for _ in range(20))) for k in range(12)] + [(12 + k, write(han, 40)) for k in range(8)]
    docs = [(k, ['{"id":7,"question":"', "<p>", "Q:", "see-also/"][k % 4] + t + '","answer"') for k, t in items[:12]] + [(k, write(han, 200) + t + write(han, 50)) for k, t in items[12:]]
    assert _passages(spark, docs, items) == {(k, k): 0 for k, _ in items}


def test_passages_cut_by_the_end_or_short(spark):
    rng = random.Random(13)
    write = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    items = [(k, write(n).replace("  ", "ab").strip().ljust(n, "q")) for k, n in enumerate([96, 96, 128, 160, 208, 13, 24, 25, 37, 38, 47, 47, 12])]
    text = dict(items)
    docs = [(k, text[k][: -1 - k]) for k in range(5)] + [(10 + k, write(100) + text[k][: -1 - k]) for k in range(5)]
    want = {(k + a, k): k + 1 for k in range(5) for a in (0, 10)}
    for k in range(5, 13):
        most, own = int(0.08 * len(text[k])), list(text[k])
        for e in range(most):
            own[len(own) * (2 * e + 1) // (2 * most)] = "#"
        docs += [(20 + k, f"{write(60)}{''.join(own)}{write(40)}"), (40 + k, "".join(own[1:]) if most == 0 else "".join(own))]
        want |= {(20 + k, k): most} | ({(40 + k, k): most} if most else {})
    assert _passages(spark, docs, items) == want


def test_toxicity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 6)))
    vocabulary = [word() for _ in range(300)]
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        rows.append((k, " ".join([*(rng.choice(vocabulary) for _ in range(30)), *(["nasty", "vilest"] if bad else [])])))
        labels.append((k, int(bad)))
    rows += [(1000, "a n4sty t e x t of n a s t y words"), (1001, None), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[k].predicted == bad for k, bad in labels if got[k].held_out)
    assert got[1000].predicted == 1 and got[1001].predicted == got[1002].predicted == 0
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)


def test_conversations(spark):
    log = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", None), (3, 0, "user", "hi"), (3, 1, "bot", ""), (4, 0, "user", "hi"), (4, 1, "bot", None), (4, 1, "bot", None)]
    log += [(None, 0, None, "alone"), (None, 5, None, "alone"), (None, 3, "user", "hi"), (None, 0, "user", "alone"), (7, None, "user", "x"), (None, 1, "user", "x")]
    log = [(c, t, r, x, 1, "y", 2) for c, t, r, x in log]
    columns = "conv_id long, turn int, role string, text string, pos int, h1 string, n_turns int"
    found = [(r.conv_id, r.n_turns, r.rendered) for r in chat.maximal_conversations(spark.createDataFrame(log, columns)).collect()]
    say = lambda *turns: "\n".join(f"<|{r}|>\n{x}\n<|end|>" for r, x in turns)
    want = [
        (2, 2, say(("user", "hi"), ("bot", ""))), (3, 2, say(("user", "hi"), ("bot", ""))), (7, 1, say(("user", "x"))),
        (None, 1, say(("unknown", "alone"))), (None, 1, say(("user", "alone"))),
    ]
    assert Counter(found) == Counter(want)


def test_conversations_against_brute_force(spark):
    """Logs that grow turn by turn, among them one of 700 turns, and a table of rows without an id; then no rows at all."""
    rng = random.Random(8)
    logs = {}
    for k in range(60):
        whole = [(rng.choice("ab"), rng.choice(["x", "y", None])) for _ in range(700 if k == 0 else rng.randint(1, 6))]
        for n in rng.sample(range(1, len(whole) + 1), min(3, len(whole))):
            logs[len(logs)] = whole[:n]
    rows = [(c, t, r, x) for c, turns in logs.items() for t, (r, x) in enumerate(turns)] + [(None, k, "ab"[k % 2], f"q{k % 3}") for k in range(400)]
    columns = "conv_id long, turn int, role string, text string"
    found = sorted((r.conv_id, r.n_turns) for r in chat.maximal_conversations(spark.createDataFrame(rows, columns)).collect() if r.conv_id is not None)
    longest = [c for c, own in logs.items() if not any(o[: len(own)] == own and (len(o) > len(own) or d < c) for d, o in logs.items() if d != c)]
    assert found == [(c, len(logs[c])) for c in longest]
    assert chat.maximal_conversations(spark.createDataFrame(rows, columns)).where("conv_id is null").count() == 6
    assert chat.maximal_conversations(spark.createDataFrame([], columns)).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels, items = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    frames = [
        token_files.encode_to_files(none, tokenizer_file("byte_bpe_50k.json"))[1], packing.pack_documents(none, tokenizer_file("word_bpe_49k.json")),
        substring_dedup.remove_repeats(none), suffix_dedup.remove_repeated_bytes(none), minhash_dedup.near_duplicates(none), quality.judge(none),
        pii.find_personal_data(none), toxicity.score(none, labels), decontaminate.benchmark_passages(none, items),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_decontamination_of_every_length(spark):
    """Items of 1 to 130 bytes, whole and with the edits they may have, each glued into a text of its own; a text that two items share; a second benchmark of the same size."""
    rng = random.Random(12)
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyzé ")
    items = {n: "".join(letter() for _ in range(200)).encode()[:n].decode("utf-8", "ignore").ljust(n, "q") for n in range(1, 131)}
    around = lambda n: "".join(rng.choice("ABCDE") for _ in range(n))
    docs = spark.createDataFrame([(n, around(30) + t + around(40), "x") for n, t in items.items()], "doc_id long, text string, item_id string").repartition(3)
    benchmark = spark.createDataFrame([*[(n, t) for n, t in items.items()], (900, items[60]), (901, items[60]), (901, items[60]), (902, None), (903, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.benchmark_passages(docs, benchmark).collect()}
    assert all(found.get((n, n)) == 0 for n in items)
    assert found[60, 900] == found[60, 901] == 0 and not {902, 903} & {i for _, i in found}
    other = spark.createDataFrame([(n, t[::-1]) for n, t in items.items()], "item_id long, text string")
    again = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_passages(docs, other).collect()}
    assert not {(n, n) for n in range(40, 131)} & again


@pytest.mark.parametrize("length", [48, 64, 79, 96, 200])
def test_decontamination_recall_by_length(spark, length):
    rng = random.Random(length)
    write = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    items = {k: write(length) for k in range(60)}
    docs = []
    for k, t in items.items():
        own = list(t)
        for _ in range(int(decontaminate.RATIO * length)):
            at = rng.randrange(len(own))
            own[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "#", "#"])
        docs.append((k, write(100) + "".join(own) + write(rng.randrange(100))))
    found = decontaminate.benchmark_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = found.where("doc_id = item_id").count() / len(items)
    print(f"length {length}: recall {got:.3f}")
    assert got >= 0.9

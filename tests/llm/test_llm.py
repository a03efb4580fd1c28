"""The text operators against brute force, on small tables with nulls, empty texts, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textquarry.llm import common, contexts, fingerprints, language_model, mixing, near_dups, packing, quality_classifier, quality_rules, secrets
from textquarry.llm.bpe import Transducer
from textquarry.llm.common import staged
from textquarry.llm.components import components
from textquarry.llm.spans import digest_columns
from textquarry.llm.token_counts import Counter, count_tokens, tokenizer_text

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, size string, base string"


def texts():
    rng = random.Random(4)
    words = ["the", "of", "naïve", "Straße", "año", "it's", "42", "x_y", "漢字", "a.b", "e-mail", "!!", "don't"]
    out = [None, "", " \n\t ", "word", "<|endoftext|> a<|endoftext|>", " mixed　space", "x" * 300, "a'b 'll 're's"]
    return out + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + rng.choice(["", "\n", "  "]) for _ in range(40)]


def table(spark, rows):
    """Documents from (doc_id, text, source), with columns whose names clash with results'."""
    return spark.createDataFrame([(i, t, "en", s, None, "clash", "clash", "clash") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["a", "b", None][i % 3]) for i, t in enumerate(texts())]
    return table(spark, rows + rows[5:8]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


# --- token counts -------------------------------------------------------------------------------------------------------------------


def test_transducer_is_the_library():
    for path in (BYTES, WORDS):
        ours, theirs = Transducer(tokenizer_text(path)), Tokenizer.from_file(path)
        rng = random.Random(1)
        words = ["".join(rng.choice("abcdefghi thenmsortuvwz") for _ in range(rng.randint(1, 14))).replace(" ", "") or "a" for _ in range(800)] + ["a" * 200, "ab" * 90]
        for w, e in zip(words, theirs.encode_batch(words, add_special_tokens=False), strict=True):
            assert ours.encode(w.encode()) == e.ids, w


def test_token_counts(docs, none):
    library = Tokenizer.from_file(BYTES)
    got = count_tokens(docs, BYTES, limit=20)
    assert got.count() == docs.count()
    for r in got.collect():
        want = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len((r["text"] or "").encode()), want > 20)
    assert count_tokens(none, BYTES).count() == 0


def test_token_counts_of_random_texts():
    library, counter = Tokenizer.from_file(BYTES), Counter(tokenizer_text(BYTES))
    rng = random.Random(9)
    many = ["".join(rng.choice("'srvle td m12 \n\t é漢!? ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert counter.count(many).tolist() == [len(e.ids) for e in library.encode_batch(many, add_special_tokens=False)]


# --- packing ------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [16, 64])
def test_packing(docs, none, capacity):
    library = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for i, t, _ in plain(docs):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = packing.pack_documents(docs, WORDS, capacity).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    check_places(rows, capacity)
    assert len({r["sequence_id"] for r in rows}) <= 1.1 * sum(r["length"] for r in rows) / capacity + 2
    assert packing.pack_documents(none, WORDS, capacity).count() == 0


def test_new_words_go_to_the_library_together():
    tokens, library, calls = packing.WordTokens(tokenizer_text(WORDS)), Tokenizer.from_file(WORDS), collections.Counter()

    class Counted:
        def __init__(self, own):
            self.own = own

        def __getattr__(self, name):
            calls[name] += 1
            return getattr(self.own, name)

    for name, x in list(vars(tokens).items()):
        if isinstance(x, Tokenizer):
            setattr(tokens, name, Counted(x))
    text = " ".join(f"né{''.join(x)}W{k}" for k, x in enumerate(itertools.product("!?.,;:-", repeat=4)))
    assert tokens.ids([text]) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert 0 < sum(calls.values()) <= 3


@pytest.mark.parametrize("most", [2, 60, 10_000])
def test_word_ids_around_any_character(most):
    library, tokens = Tokenizer.from_file(WORDS), packing.WordTokens(tokenizer_text(WORDS), most, most, 5)
    signs = [*map(chr, range(0x370)), *"Σς漢　\u2028ﬁⱥ\U0001f600"]
    many = [f"a{c}!{c}B 'S{c}'s{c}1 {c}\n{c * 3}<|endoftext|>{c} the" for c in signs] + ["", " ", "\n\n", " x\n"]
    got = [x for k in range(0, len(many), 7) for x in tokens.ids(many[k : k + 7])]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(many, add_special_tokens=False)]


def test_known_keys_that_come_again_stay():
    known = packing.Known(8)
    for keys in ("abca", "defghia", "ab"):
        known.trim()
        where, new = known.find(list(keys))
        known.learn(np.array([ord(x) for x in new for _ in range(ord(x) % 3)], "<u4"), np.array([ord(x) % 3 for x in new], np.int64))
        ids, ends = known.gather(where)
        assert ids.tolist() == [ord(x) for x in keys for _ in range(ord(x) % 3)]
        assert ends.tolist() == np.cumsum([ord(x) % 3 for x in keys]).tolist()
    assert new == ["b"] and list(known.at) == ["a", "b"]


def check_places(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_plan_uses_each_piece_once():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randint(1, 100): rng.randint(1, 500) for _ in range(rng.randint(1, 60))}
        rows, free = sorted(packing.plan(histogram, 100)), collections.defaultdict(list)
        for k, (length, first, sequence, each, offset) in enumerate(rows):
            end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else histogram[length]
            for turn in range(end - first):
                free[sequence + turn // each].append((offset + turn % each * length, length))
        assert sum(map(len, free.values())) == sum(histogram.values())
        for own in free.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 100


def test_sequences_hold_the_ids(spark, docs):
    """Of all rows, also those that share an id or have none."""
    library = Tokenizer.from_file(WORDS)
    few = [(1, "one text here", "a"), (1, "another text", "a"), (None, "a third one", "a"), (None, "a third one", "a"), (2, None, "a")]
    for rows in (docs, table(spark, few)):
        packed = staged(packing.pack_documents(rows, WORDS, 64))
        got = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(packed, rows, WORDS, 64).collect()}
        assert {k: len(x) for k, x in got.items()} == {r["sequence_id"]: r["n"] for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
        placed = collections.Counter()
        for r in packed.collect():
            ids = got[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
            assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
            placed[r["doc_id"], r["start"], tuple(ids)] += 1
        want = collections.Counter()
        for i, t, _ in plain(rows):
            ids = [*library.encode(t, add_special_tokens=False).ids, 1]
            want.update((i, k, tuple(ids[k : k + 64])) for k in range(0, len(ids), 64))
        assert placed == want


# --- mixing -------------------------------------------------------------------------------------------------------------------------


def fill(sizes, weights, budget):
    targets, capped = {}, set()
    while True:
        left = {s for s in sizes if s not in capped}
        rest = budget - sum(2 * sizes[s] for s in capped)
        total = sum(weights[s] for s in left)
        targets = {s: 2.0 * sizes[s] if s in capped else rest * weights[s] / total for s in sizes}
        over = {s for s in left if targets[s] > 2 * sizes[s]}
        if not over:
            return targets
        capped |= over


def test_mixing(docs, none):
    sizes, got = collections.Counter(), mixing.mix(docs).collect()
    for _, t, s in plain(docs):
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(5)).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mixing.mix(none).count() == 0


def test_targets_of_random_sources(spark):
    rng = random.Random(3)
    for n in (1, 2, 9):
        sizes = {f"s{k}": rng.choice([0, 1, 10, 1000]) for k in range(n)} | {"t": 7}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
        weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
        want = fill(sizes, weights, 1.5 * sum(sizes.values()))
        got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes)


def test_stream_is_sorted_and_within_budget(docs):
    rows = mixing.stream(staged(mixing.served(docs))).collect()
    assert [r["finish_time"] for r in rows] == sorted(r["finish_time"] for r in rows)
    assert sum(r["taken"] for r in rows) == sum(r["taken"] for r in mixing.mix(docs).collect())


def test_truncated_queue_is_the_closed_form(spark):
    """Each document's words in the queue up to the budget equal its share of its source's target, cut in running order."""
    rng = random.Random(6)
    rows = [(i, " ".join("x" * rng.choice([1, 1, 2, 40])), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(600)] + [(700, " ".join("y" * 3000), "d"), (701, "", "e"), (702, None, "e")]
    got = staged(mixing.served(table(spark, rows))).collect()
    docs = {}
    for r in got:
        d = docs.setdefault(r["doc_id"], dict(source=r["source"], size=r["size"], start=r["_from"], whole=r["source_size"], budget=r["budget"], taken=0))
        d["taken"] += r["taken"]
    assert len(docs) == len(rows)
    for d in docs.values():
        want = sum(max(0, min(d["size"], d["budget"] - d["start"] - k * d["whole"])) for k in (0, 1))
        assert d["taken"] == want


# --- language model -----------------------------------------------------------------------------------------------------------------


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    k, c = 2, 4
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = language_model.Model(norm(rng.random(k), 0), norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((c, k)), 0))
    ids = np.array([0, 2, 1, 3], "<u2")
    total = 0.0
    for path in np.ndindex(*[k] * len(ids)):
        p = model.start[path[0]] * model.emit[ids[0], path[0]]
        for a, b, x in zip(path, path[1:], ids[1:], strict=False):
            p *= model.move[a, b] * model.emit[x, b]
        total += p
    assert math.isclose(language_model.forward(model, [ids.tobytes(), ids[:1].tobytes()])[0], math.log10(total), rel_tol=1e-9)
    for t, n, b in language_model.segments([ids.tobytes()] * 3, c - 1):
        state, moves, _, p = language_model.expected_counts(model, t, n, b)
        assert math.isclose(p, 3 * math.log(total), rel_tol=1e-9)
        assert math.isclose(state.sum(), 12)
        assert math.isclose(moves.sum(), 9)


def test_scores(docs, none):
    rows = [(i, [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t.encode().lower().decode())] + [None]) for i, t, _ in plain(docs)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, x in rows if not held(i) for w in x)
    total, norm = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    want = sorted((i, held(i), len(x), sum(c[w] > 0 for w in x), total, round(sum(math.log10((c[w] + 0.1) / norm) for w in x), 6)) for i, x in rows)
    got = language_model.score(docs, states=3, passes=2).collect()
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert language_model.score(none, states=2, passes=1).count() == 0


def test_score_is_class_times_word(spark):
    """Scores end to end by hand: the state sequence's probability of the classes, times each rare word's share of its class; rare words, unknown ones and a very long text."""
    rng = random.Random(3)
    words = [f"w{k:05}" for k in range(19_000)]  # more than have a class of their own
    rows = [(k, " ".join(words[k * 200 : k * 200 + 200] + [rng.choice(words[:50]) for _ in range(rng.randint(1, 50))]), "a") for k in range(95)] + [(500, "never seen words", "a"), (501, None, "a"), (502, " ".join(rng.choice(words) for _ in range(5000)), "a")]
    docs = table(spark, rows).coalesce(1).cache()
    base = language_model.rows_of(docs)
    counts = staged(language_model.word_counts(base))
    vocab = language_model.vocabulary(counts, base.filter(~F.col("held_out")).count())
    texts_ = staged(language_model.encoded(base, vocab))
    model = language_model.train(texts_.filter(~F.col("held_out")), vocab, 3, 2)
    c = {r["word"]: r["c"] for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in language_model.score(docs, states=3, passes=2).collect()}
    for i, t, _ in rows:
        now, total = model.start, 0.0
        tokens = (t or "").split()
        for k, w in enumerate([*tokens, None]):
            if w is None:
                at = vocab.end
            elif w.encode() in vocab.frequent:
                at = vocab.frequent[w.encode()][0]
            else:
                own = language_model.shared_class(w[-2:])
                at = language_model.FREQUENT + own
                total += math.log10((c.get(w, 0) + 0.1) / (vocab.mass[own] + 0.1 * (vocab.kinds[own] + 1)))
            now = (now @ model.move if k else now) * model.emit[at]
            total += math.log10(now.sum())
            now = now / now.sum()
        assert math.isclose(got[i], total, rel_tol=1e-5), i


# --- personal data and secrets ------------------------------------------------------------------------------------------------------

PII = ["mail joe.x@mail.example.com now", "host 10.0.0.255 and 999.1.1.1", "pay 4111 1111 1111 1111 ok", "call +1 (487) 555-7209 x", "a@b", "@@", "+1", "1.2.3.4.5.6.7.8", None, ""]


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and contexts.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_patterns():
    rng = random.Random(1)
    for t in [x or "" for x in PII] + ["".join(rng.choice("aA1.@-+ ()9d%_5\n") for _ in range(60)) for _ in range(8000)]:
        assert contexts.base_spans(t) == brute_pii(t), t
    assert contexts.luhn("4111111111111111")


def test_bootstrap_finds_what_the_rules_miss(spark, none):
    seen = [(i, f"customer card: 4111 1111 1111 {n:04d} end", "a") for i, n in enumerate(range(2000)) if contexts.luhn(f"411111111111{n:04d}")][:60]
    rows = [*seen, (9001, "customer card: 4111 1111 1111 1112 end", "a"), (9002, "plain 4111 text", "a"), *[(9100 + k, t, "a") for k, t in enumerate(PII)]]
    got = {r["doc_id"]: r for r in digest_columns(contexts.personal_data(table(spark, rows)), contexts.KINDS).collect()}
    assert got[9001]["n_card"] == 0
    assert "card:" in got[9001]["spans"]
    assert got[9002]["spans"] == ""
    for i, t, _ in rows:
        base = ",".join(f"{contexts.KINDS[k]}:{a}:{b}" for a, k, b in brute_pii(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
    assert contexts.personal_data(none).count() == 0


def plain_scores(mentions, rounds, support, threshold):
    """Pattern scores by loops over patterns and instances; mentions are (pattern, string, kind) with '' for no seed."""
    n = collections.Counter((p, s) for p, s, _ in mentions)
    kinds = collections.defaultdict(set)
    for _, s, kind in mentions:
        if kind:
            kinds[s].add(kind)
    sure, best = {(s, k) for s in kinds for k in kinds[s]}, {}
    for _ in range(rounds):
        proposed = {(p, k) for p, s in n for t, k in sure if s == t}
        value = {(p, k, s): (float(k in kinds[s]) if s in kinds else best.get((s, k), 0.0)) for p, k in proposed for q, s in n if p == q}
        scores = {}
        for p, k in proposed:
            own = [(math.log1p(n[p, s]), v) for (q, j, s), v in value.items() if (q, j) == (p, k)]
            scores[p, k] = sum(w * v for w, v in own) / (sum(w for w, _ in own) + support)
        best = {}
        for p, k, s in value:
            if s not in kinds:
                best[s, k] = max(best.get((s, k), 0.0), scores[p, k])
        sure = {(s, k) for s in kinds for k in kinds[s]} | {key for key, v in best.items() if v >= threshold}
    return scores


def test_pattern_scores_against_loops(spark):
    rng = random.Random(7)
    patterns = [(f"b{k}", f"=f{k % 3}", f"a{k % 2}") for k in range(9)]
    seeds = {f"s{k}": rng.choice(["email", "phone", ""]) for k in range(40)}
    mentions = [(rng.choice(patterns), s, seeds[s] if rng.random() < 0.8 else "") for s in rng.choices(list(seeds), k=260)]
    seen = spark.createDataFrame([(*p, s, k) for p, s, k in mentions], "before string, form string, after string, string string, kind string")
    for rounds, threshold in ((1, 0.5), (3, 0.3), (3, 0.6)):
        got = {((r["before"], r["form"], r["after"]), r["kind"]): r["score"] for r in contexts.score_patterns(seen, rounds, 3, threshold).collect()}
        want = plain_scores(mentions, rounds, 3, threshold)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bootstrap_finds_other_forms(spark):
    """Forms that no base rule has, by left or right context; instances of one context lead to another one; long ones too."""
    texts = [f"please call +1 (487) 555-{n} soon" for n in range(1000, 1080)] + [f"please mail p{n}@mail.example.com soon" for n in range(40)]
    texts += [f"w{n}: +1 (487) 556-{n} mobile" for n in range(1000, 1040)]
    both = [f"(487) 557-{n}" for n in range(1000, 1040)]
    texts += [f"please call {x} soon" for x in both] + [f"they dial {x} then" for x in both]
    finds = [("call", "487-555-7209", "later", "phone"), ("call", "(487) 555-7209", "later", "phone"), ("other", "487-558-7209", "mobile", "phone"), ("dial", "487.559.7209", "x", "phone")]
    finds += [("mail", "joe@localhost", "later", "email"), ("mail", "j" * 120 + "@localhost", "later", "email")]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(9000 + i, f"{a} {x} {b}", "a") for i, (a, x, b, _) in enumerate(finds)] + [(9900, "year 2024 and room 487-555 of 1234567", "a")]
    rows += [(9800, "call" + " " * 5000 + "487-555-7209 later", "a"), (9801, "z" * 300_000 + " call 487-555-7209", "a")]
    got = {r["doc_id"]: r["spans"] for r in digest_columns(contexts.personal_data(table(spark, rows)), contexts.KINDS).collect()}
    assert (got[9800], got[9801]) == ("phone:5004:5016", "phone:300006:300018")
    for i, (a, x, _, kind) in enumerate(finds):
        assert got[9000 + i] == f"{kind}:{len(a) + 1}:{len(a) + 1 + len(x)}", finds[i]
    assert got[9900] == ""


def test_redaction(spark):
    rows = table(spark, [(k, t, "a") for k, t in enumerate(PII)] * 2)
    out = contexts.redact(rows, contexts.personal_data(rows))
    assert out.count() == 2 * len(PII)
    assert {r["text"] for r in out.filter("doc_id in (0, 2, 8)").collect()} == {"mail <email> now", "pay <card> ok", None}


def brute_secrets(t):
    out = [(m.start(), "assign", m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 12]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_patterns():
    rng = random.Random(1)
    parts = ["password", "token", "Secret", "Api_Key", "=", ":", " ", '"', "abc", "AKIA", "ABCDEF123", "0123456789abcdef", "xyz123456", "ſecret", ".", "\n"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(12))
        assert secrets.scan(t)[0] == brute_secrets(t), t


def test_weak_parts_need_a_partner(spark, none):
    ident, weak = "AKIA" + "ABCDEFGH12345678", "Zx9" + "qWe7rTy2uIo4pAs6"
    rows = [(1, f"id {ident} key {weak}", "a"), (2, f"key {weak} alone", "a"), (3, f"id {ident}" + " x" * 400 + f" key {weak}", "a"), (4, None, "a"), (5, "", "a"), (6, f"post https://h.example.com/v1 {weak}", "a"), (6, "", "a")]
    got = [(r["doc_id"], r["spans"], r["n_access"]) for r in digest_columns(secrets.secrets(table(spark, rows)), secrets.KINDS).collect()]
    assert len(got) == 7
    linked = {i for i, s, _ in got if "assign:" in s}
    assert linked == {1, 6}
    assert all(n == 1 for i, _, n in got if i in (1, 3))
    assert secrets.secrets(none).count() == 0


def test_endpoints_of_any_ending_and_length():
    weak = "Zq8x" * 6
    long = ".".join(f"l{k}" for k in range(40)) + ".internal"
    for endpoint in ("https://a.b/c", "postgresql+async://db:1/x", "api.service.ai", "db.prod.local:5432", "host.example:80", "10.0.0.7:8443", long, "xn--bcher-kva.shop.museum", "S3.EU.Example"):
        found = [p for p in secrets.scan(f"see {endpoint} {weak}")[1] if p[3] == "endpoint"]
        assert found == [(4, "", 4 + len(endpoint), "endpoint")], endpoint
    for other in ("two.words", "e.g. this", "1.2.3.4", "joe@mail.example.com", "v1.2.3", "a..b.c", "3.14:x"):
        assert not [p for p in secrets.scan(f"see {other} {weak}")[1] if p[3] == "endpoint"], other
    for hostile in ("a." * 200_000, "a-" * 200_000 + ".", "x" * 400_000 + "://", "a.b." * 100_000 + "9"):
        secrets.scan(hostile)


def test_scopes_at_every_alignment(spark):
    """Both orders, several gaps, all places in a bin: the bins lose no pair that the interval condition admits."""
    scope, rows = 20, []
    for length in (4, 15, 50):
        for gap in (1, 10, 18, 19, 20, 21):
            for place in range(2 * scope):
                other = place + length + gap
                rows.append((len(rows), [(place, "assign", place + length), (other, "", other + 5)]))
                rows.append((len(rows), [(place, "", place + 5), (place + 5 + gap, "assign", place + 5 + gap + length)]))
    parts = [(i, a, kind, b, "secret" if kind else "identifier") for i, spans in rows for a, kind, b in spans]
    want = [i for i, ((a, _, b), (c, _, d)) in rows if c < b + scope and d > a - scope]
    got = secrets.linked(spark.createDataFrame(parts, "_row bigint, start int, kind string, end int, role string"), scope).collect()
    assert sorted(r["_row"] for r in got) == want
    assert {r["kind"] for r in got} == {"assign"}


def test_opaque_tokens_have_their_own_digits():
    assert [p for p in secrets.scan("abcdefghijklmnopqr,1 https://h.example.com/v1")[1] if p[1]] == []
    assert [p[:3] for p in secrets.scan("abcdefghijklmnopq1 https://h.example.com/v1")[1] if p[1]] == [(0, "assign", 18)]


def test_weak_parts_against_brute_force(spark):
    """Added spans of random texts equal those by comparing all parts of each text."""
    rng = random.Random(9)
    pool = ["AKIA" + "ABCDEFGH12345678", "AKIA" + "ABCDEFGH1", "token=abcdef1", "Zx9" + "qWe7rTy2uIo4pAs6", "0a1b2c3d4e5f", "https://h.example.com/v1", "db.host.example.io", "x" * 90, "plain words", "\n"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 14))), "a") for k in range(300)] + [(400, "y" * 300_000 + " AKIA" + "ABCDEFGH12345678 token=abcdef1", "a")]
    got = {r["doc_id"]: sorted((x["start"], x["kind"], x["end"]) for x in r["added"]) for r in secrets.secrets(table(spark, rows)).collect()}
    for i, t, _ in rows:
        parts = secrets.scan(t)[1]
        fits = lambda r, q: q == "secret" if r == "identifier" else q in ("identifier", "endpoint")
        want = sorted({(a, k, b) for a, k, b, r in parts if k and any(fits(r, q) and c < b + 200 and d > a - 200 for c, _, d, q in parts)})
        assert got[i] == want, t
    assert sum(map(len, got.values())) > 100
    assert got[400]


def test_long_tokens_and_urls_are_whole_parts():
    ident, weak = "AKIA" + "ABCDEFGH12345678", "Zx9" + "qWe7rTy2uIo4pAs6"
    for n in (150, 197, 198, 5000):
        key = "Q" * n + "7z"
        assert (21, "assign", 21 + len(key), "secret") in secrets.scan(f"{ident} {key}")[1]
        late = "z" * (n - 30) + "/" * 30 + "7"
        assert (21, "assign", 21 + len(late), "secret") in secrets.scan(f"{ident} {late}")[1]
        url = "https://h.example/" + "p" * n
        assert (0, "", len(url), "endpoint") in secrets.scan(f"{url} {weak}")[1]
    assert not secrets.scan(f"{ident} " + "Q" * 5000)[1][1:]
    assert len(secrets.scan("ab-" * 200_000 + " " + "x" * 16 + "." * 200_000)[1]) == 0


# --- near duplicates ----------------------------------------------------------------------------------------------------------------


def shingle_sets(rows, k):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def brute_components(sets):
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def near_rows():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "a b"), (5, "A  b")]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 7)):
            x = list(base)
            for _ in range(rng.randint(0, len(x) // 12)):
                x[rng.randrange(len(x))] = rng.choice(words)
            rows.append((len(rows), " ".join(x)))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, none, k):
    rows = near_rows()
    sets = shingle_sets(rows, k)
    want = brute_components(sets)
    got = near_dups.near_duplicates(table(spark, [(i, t, "a") for i, t in rows] + [(None, "one", "a")]), shingle=k).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"]
            continue
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert near_dups.near_duplicates(none).count() == 0


def test_link_of_two_that_never_lead(spark):
    """All texts of a group are under 0.8 to v but w, and w and v never lead a bucket: only comparing all pairs still apart finds their link."""
    rng = random.Random(3)
    w = [f"w{k}" for k in range(92)]
    rows = [(i, " ".join(w + [f"j{rng.randrange(10**6)}" for _ in range(6)])) for i in range(60)] + [(100, " ".join(w)), (101, " ".join(w[:78]))]
    want = brute_components(shingle_sets(rows, 1))
    assert want[101] == 0
    got = near_dups.near_duplicates(table(spark, [(i, t, "a") for i, t in rows]), shingle=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_odd_sketches_drop_what_is_below(spark):
    """Pairs at 0.8 and above always pass; those well below, which MinHash bands still propose, do not."""
    rng = random.Random(2)
    rows, want = [], []
    sign = near_dups.Signer(1)
    for size in (60, 150, 1500, 9000):
        for like in (0.8, 0.82, 0.9, 0.7, 0.6, 0.3):
            both = math.ceil(size * 2 * like / (1 + like))
            base = [f"w{k}" for k in rng.sample(range(10**7), size)]
            other = base[:both] + [f"v{k}" for k in rng.sample(range(10**7), size - both)]
            (n, _, _, s), (m, _, _, t) = sign(" ".join(base)), sign(" ".join(other))
            rows.append((len(rows), s, t, n + m))
            want.append(like >= 0.8)
    found = spark.createDataFrame(rows, "k int, s array<bigint>, t array<bigint>, n bigint").select("k", near_dups.likely(F.col("s"), F.col("t"), F.col("n"), 0.8).alias("x")).collect()
    assert [r["x"] for r in sorted(found)] == want


@pytest.mark.parametrize("edits", [(0, 4), (7, 9), (2, 13)])
def test_large_groups_of_near_copies(spark, edits):
    """500 copies just above, just below and around the threshold, by random edits from few words, equal brute force."""
    rng = random.Random(edits[1])
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(500):
        x = list(base)
        for at in rng.sample(range(90), rng.randint(*edits)):
            x[at] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(x)))
    rows += [(900, " ".join(base[:70])), (901, " ".join(base[20:])), (902, "w1 w2"), (902, " ".join(base))]
    plain_rows = [(i, t) for i, t in rows if i != 902]
    sets = shingle_sets(plain_rows, 1)
    sets[902] = shingle_sets([(902, " ".join(base))], 1)[902]
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(table(spark, [(i, t, "a") for i, t in rows]), shingle=1).collect()}
    assert got == brute_components(sets)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[k] for k in range(41)} == {0}
    assert {got[k] for k in range(100, 140)} == {100}


# --- fingerprints -------------------------------------------------------------------------------------------------------------------


def test_fingerprints(docs, none, spark):
    one = docs.dropDuplicates(["doc_id"])
    order = sorted(((r["doc_id"], r["text"] or "") for r in one.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_edits(one).collect()}
    assert len(got) == len(order)
    own = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(one).collect()}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[1][:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i]["fingerprint"] == own[i]
        assert got[i]["near_next"] == fingerprints.likeness(fingerprints.from_text(own[i]), fingerprints.from_text(own[after[0]]))
    assert fingerprints.compare_with_edits(none).count() == 0
    assert fingerprints.compare_with_edits(table(spark, [(1, "alone here", "a")])).first()["near_next"] == 1.0


def test_fingerprints_of_equal_and_null_ids_and_long_texts(spark):
    """Rows with one id, or none, follow each other by text; likenesses equal those of the sketches by hand."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(60_000))
    rows = [(5, "a b c d e f g", "x"), (5, "b c d e f g h", "x"), (5, None, "x"), (None, "t1 t2 t3 t4 t5 t6", "x"), (None, "", "x"), (9, long, "x"), (7, long[:200_000], "x")]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = sorted((r["doc_id"] is None, -(r["doc_id"] or 0), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["fingerprint"]) for r in fingerprints.compare_with_edits(table(spark, rows)).collect())
    cut, want = fingerprints.Shingles(5), []
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, other, following = (fingerprints.sketch(cut(x), 8) for x in (t, edited, after))
        want.append((i is None, -(i or 0), len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.likeness(own, other), fingerprints.likeness(own, following), fingerprints.as_text(own)))
    assert got == sorted(want)


def test_ranges_of_ids_join_up(spark):
    """Many ranges, with hot and missing ids, give each document its next one."""
    rows = [(k * 3 if k % 4 else 300, f"text {k} of many words here", "x") for k in range(400)]
    order = sorted(((i, t) for i, t, _ in rows), key=lambda r: (-r[0], r[1]))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.compare_with_edits(table(spark, rows)).collect()) == want


def test_sketches_merge_and_contain():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 1 << 63, 4000, np.uint64) * np.uint64(2)) for _ in range(2))
    whole = np.union1d(a, b)
    s = lambda x: fingerprints.sketch(x, 8)
    assert fingerprints.merged(s(a), s(b), 8).tolist() == s(whole).tolist()
    assert fingerprints.containment(s(a), s(whole)) == 1.0
    assert abs(fingerprints.containment(s(whole), s(a)) - 0.5) < 0.1


# --- quality ------------------------------------------------------------------------------------------------------------------------


def brute_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for own in at.values() if len(own) > 1 for i in own for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics(spark, none):
    rng = random.Random(6)
    rows = [(k, t, "a") for k, t in enumerate(texts() + ["a b c d e a b c d e f", "a a a a a a", "x\nx\n\ny\n x\nx", "### <|>"] + [" ".join(rng.choice("abc") for _ in range(40)) for _ in range(20)])]
    got = {r["doc_id"]: r for r in quality_rules.statistics(table(spark, rows)).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_statistics(t or ""), t
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    judged = quality_rules.judge(table(spark, rows), labels).collect()
    assert all(r["kept"] != r["base_failed"] for r in judged)
    assert quality_rules.judge(none, labels).count() == 0


def test_decision_list_learns_a_conjunction():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.3)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality_rules.holds(r, x)
    assert (hit == bad).mean() > 0.98
    assert quality_rules.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_decision_list_of_few_rows_holds_elsewhere():
    """Some thirty bad rows are enough for rules that are precise on others, in any order."""
    rng = np.random.default_rng(7)
    x = {"a": rng.random(1400), "b": rng.random(1400)}
    bad = (x["a"] > 0.92) | (rng.random(1400) < 0.01)
    for turn in range(4):
        order = np.random.default_rng(turn).permutation(400)
        rules = quality_rules.learn({k: v[order] for k, v in x.items()}, bad[order])
        assert rules
        hit = np.zeros(1400, bool)
        for r in rules:
            hit |= quality_rules.holds(r, x)
        assert bad[400:][hit[400:]].mean() > 0.8
        assert hit[400:][bad[400:]].mean() > 0.6


def test_kept_is_the_list_of_rules(spark):
    """Verdicts of all rows, nulls and repeated ones too, equal the base rule and the learned list by hand."""
    docs, labels = graded(spark)
    more = docs.unionByName(table(spark, [(800, None, "a"), (801, "", "a"), (802, " ".join(["same"] * 40), "a"), (802, " ".join(["same"] * 40), "a"), (803, "long " * 200_000, "a")]))
    stats = staged(quality_rules.statistics(more.select("doc_id", "text")).drop("text"))
    rules = quality_rules.learn_rules(stats, labels)
    assert rules
    for r in quality_rules.judge(more, labels).collect():
        x = {k: np.array([float(eval(e, {"greatest": max}, r.asDict()))]) for k, e in quality_rules.FEATURES.items()}
        first = next((k for k, rule in enumerate(rules, 1) if quality_rules.holds(rule, x)[0]), 0)
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert (r["base_failed"], r["rule"], r["kept"]) == (failed, first, not failed and not first)


def graded(spark):
    rng = random.Random(12)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(700):
        x = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        kind = k % 5
        if kind == 0:
            x = [w.upper() + "!!" for w in x]
        elif kind == 1:
            x[rng.randrange(len(x))] = rng.choice(["nasty", "vile"])
        rows.append((k, " ".join(x), "a"))
        labels.append((k, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_ordinal_classifier_on_held_out_rows(spark, none):
    docs, labels = graded(spark)
    model = quality_classifier.train(docs, labels.filter("doc_id < 500"))
    assert list(model[1]) == sorted(model[1])
    got = quality_classifier.classify(docs, model).join(labels, "doc_id").filter("doc_id >= 500").collect()
    right = [r["accepted"] == (r["quality"] == 1 and r["toxic"] == 0) for r in got]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r["tail_probability"] <= 1 and r["tail_probability"] <= r["expected_grade"] <= 2 for r in got)
    assert quality_classifier.train(docs, labels.limit(0)) is None
    assert quality_classifier.train(none, labels) is None
    odd = table(spark, [(900, None, "a"), (901, "", "a"), (902, "word1 word2", "a"), (902, "word1 word2", "a"), (903, "word3 " * 200_000, "a")]).withColumns({"_score": F.lit("own"), "accepted": F.lit("old")})
    rows = quality_classifier.classify(odd, model).collect()
    assert len(rows) == 5
    assert all(r["_score"] == "own" and r["accepted"] in (True, False) for r in rows)
    assert len({r["tail_probability"] for r in rows if r["doc_id"] == 902}) == len({r["tail_probability"] for r in rows if r["doc_id"] in (900, 901)}) == 1
    twice = docs.unionByName(docs).unionByName(docs)
    again = quality_classifier.train(twice.repartition(7), labels.filter("doc_id < 500"))
    assert np.array_equal(again[0], model[0])
    assert quality_classifier.classify(none, model).count() == 0


def test_classifier_scores_against_plain_sums(spark):
    """Scores by worker equal sums of the weights of each text's features, with the logistic of the thresholds."""
    docs, labels = graded(spark)
    weights, theta = quality_classifier.train(docs, labels)
    for r in quality_classifier.classify(docs.limit(60), (weights, theta)).collect():
        total = sum(float(weights[b]) for b in quality_classifier.buckets(r["text"] or ""))
        tails = [1 / (1 + math.exp(t - total)) for t in theta]
        assert math.isclose(r["tail_probability"], tails[-1], rel_tol=1e-6)
        assert math.isclose(r["expected_grade"], sum(tails), rel_tol=1e-6)
        assert r["accepted"] == (r["tail_probability"] >= 0.5)


# --- pipeline -----------------------------------------------------------------------------------------------------------------------


def test_first_rows_come_from_a_few_buckets(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 1013).alias("c"), F.col("id").cast("string").alias("word")).repartition(9)
    want = sorted(((r["c"], r["word"]) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    for k in (0, 1, 37, 4999, 9000):
        assert [tuple(r) for r in common.firsts(rows, -F.col("c"), [F.desc("c"), "word"], k).collect()] == want[:k]
    drawn = sorted((r["h"], r["word"]) for r in rows.select("word", F.xxhash64("word").alias("h")).collect())
    assert sorted(r["word"] for r in common.hash_firsts(rows, ["word"], 120).collect()) == sorted(w for _, w in drawn[:120])
    assert common.hash_firsts(rows.limit(0), ["word"], 3).count() == 0


def test_vocabulary_is_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(language_model, "FREQUENT", 40)
    rng = random.Random(6)
    counts = {f"w{k}": rng.choice([1, 1, 1, 2, 3, 9, 50 + k]) for k in range(300)}
    frame = spark.createDataFrame([(w, c, k % language_model.SHARED) for k, (w, c) in enumerate(counts.items())], "word string, c bigint, class int").repartition(5)
    got = language_model.vocabulary(frame, 7)
    mine = {w.decode(): c for w, (_, c) in got.frequent.items()}
    assert len(mine) == 40 and all(counts[w] == c for w, c in mine.items())
    assert sorted(mine.values()) == sorted(counts.values())[-40:]
    left = {w: c for w, c in counts.items() if w not in mine}
    assert (got.mass.sum(), got.kinds.sum(), got.total) == (sum(left.values()), len(left), sum(counts.values()) + 7)


def test_workers_drop_what_other_operators_made():
    made = common.once(dict)
    assert list(common.slices([pa.array([1, 2, 3])], 2, made=True)) == [pa.array([1, 2]), pa.array([3])]
    assert common.once(dict) is made
    for _ in contexts.find(iter([pa.array(["a@b.c"])])):
        assert not common._MADE


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs, labels = graded(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    extra = table(spark, [(5000, "mail joe@mail.example.com about word1 word2 word3 word4", "b"), (5001, None, "b"), (5001, None, "b")] + [(6000 + k, " ".join(f"word{j}" for j in range(60)) + f" word{k % 2}", "b") for k in range(4)])
    at, counts = docs.unionByName(extra), []
    for name, stage in P.STAGES:
        at = staged(stage(spark, at, str(tmp_path)))
        counts.append((name, at.count()))
        if name != P.STAGES[-1][0]:
            assert at.columns == docs.columns
        if name.startswith("MinHash"):
            assert at.filter("doc_id between 6000 and 6003").count() == 1
            assert at.groupBy("doc_id").count().filter("count > 1").isEmpty()
        if name == "PII":
            assert at.filter("text like '%joe@%'").isEmpty()
    check_places(at.collect(), 4096)
    assert [n for n, _ in counts] == ["quality classifier", "MinHash near-dedup", "PII", "mixing sources to target weights", "best-fit packing"]


def test_near_dedup_decides_by_row(spark):
    import corpus_pipeline as P

    rng = random.Random(5)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "w"), (1, c, "x"), (2, b + " more", "x"), (2, d, "x"), (0, c + " more", "x"), (3, "", "x"), (3, " ", "x"), (None, a, "x")]
    want = {(1, a, "x"), (1, b, "w"), (2, d, "x"), (0, c + " more", "x"), (3, "", "x"), (3, " ", "x"), (None, a, "x")}
    for turned in (rows, rows[::-1]):
        got = [(r["doc_id"], r["text"], r["source"]) for r in P.near_dedup(spark, table(spark, turned), "").collect()]
        assert len(got) == len(want)
        assert set(got) == want


def mixed_rows():
    """Repeated rows, one hot id and rows without one, null sources, and sources (a large and a small share) with texts without words."""
    rng = random.Random(12)
    rows = [(rng.choice([i, i, i, 7, None]), " ".join(rng.choice("uvw") + str(rng.randrange(99)) for _ in range(rng.choice([1, 3, 30]))), rng.choice(["a", "a", "b", "c", None])) for i in range(900)]
    return rows + rows[:40] + [(2000 + k, rng.choice([None, "", " \n "]), rng.choice(["a", "c", "d"])) for k in range(120)]


INTERNAL = ["_row", "_size", "_key", "_spans", "_node", "_group", "_doc", "_text", "_order", "_head", "_p", "_taken", "_range", "_of", "_s", "_label", "copy", "taken", "finish_time", "target", "budget", "base", "added", "range", "ahead", "digest", "rep", "n_shingles", "shard", "at", "marks", "accepted", "piece", "length", "rank"]


def named_like_insides(docs):
    """Documents with constant columns of the names that operators use inside, and a map."""
    return docs.drop("size", "base", "n_tokens").withColumns({c: F.lit("stranger") for c in INTERNAL} | {"tags": F.create_map(F.lit("k"), F.col("doc_id"))})


def test_columns_named_like_insides(spark, docs, tmp_path):
    """Operators and stages give the same with them as without; stages hand them on."""
    import corpus_pipeline as P

    more = staged(named_like_insides(docs))
    rows = lambda df, *c: collections.Counter(map(repr, df.select(*c).collect()))
    for run, columns in [
        (mixing.mix, ("doc_id", "size", "source_size", "target", "taken")), (near_dups.near_duplicates, ("doc_id", "n_shingles", "component_id")), (fingerprints.compare_with_edits, ("doc_id", "edited_sha256", "near_next")),
        (lambda x: digest_columns(contexts.personal_data(x), contexts.KINDS), ("doc_id", "spans")), (lambda x: packing.pack_documents(x, WORDS, 64), ("doc_id", "piece", "length", "ids_crc32")), (lambda x: count_tokens(x, BYTES), ("doc_id", "n_tokens")),
    ]:
        assert rows(run(more), *columns) == rows(run(docs), *columns)
    graded_docs, labels = graded(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    graded_docs = graded_docs.limit(80).unionByName(table(spark, [(9000, "call joe@mail.example.com now please", "b"), (9001, None, None)] * 2))
    at, plainly = staged(named_like_insides(graded_docs)), staged(graded_docs)
    for name, stage in P.STAGES:
        at, plainly = staged(stage(spark, at, str(tmp_path))), staged(stage(spark, plainly, str(tmp_path)))
        shared = ("doc_id", "text") if name != P.STAGES[-1][0] else ("doc_id", "piece", "length", "ids_crc32")
        assert rows(at, *shared) == rows(plainly, *shared), name
        if name != P.STAGES[-1][0]:
            assert at.count() == at.filter(" and ".join(f"{c} = 'stranger'" for c in INTERNAL)).count() > 0
            assert at.filter("tags['k'] = doc_id or doc_id is null").count() == at.count()


def test_ids_of_other_types(spark):
    """Text, binary and decimal ids."""
    rows = near_rows()
    for kind, name in (("string", "concat('id-', lpad(doc_id, 5, '0'))"), ("binary", "cast(concat('b', lpad(doc_id, 5, '0')) as binary)"), ("decimal(20,2)", "cast(doc_id as decimal(20,2))")):
        docs = staged(table(spark, [(i, t, "a") for i, t in rows]).selectExpr(f"{name} as doc_id", "text"))
        assert docs.schema["doc_id"].dataType.simpleString() == kind
        named = {r["i"]: r["doc_id"] for r in table(spark, [(i, t, "a") for i, t in rows]).selectExpr("doc_id as i", f"{name} as doc_id").collect()}
        want = brute_components(shingle_sets(rows, 2))
        got = {bytes(r["doc_id"]) if kind == "binary" else r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs, shingle=2).collect()}
        assert got == {bytes(named[i]) if kind == "binary" else named[i]: named[c] for i, c in want.items()}
        order = sorted(rows, reverse=True)
        edits = {bytes(r["doc_id"]) if kind == "binary" else r["doc_id"]: r["edited_sha256"] for r in fingerprints.compare_with_edits(docs).collect()}
        for k, (i, t) in enumerate(order):
            t, after = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(t) // 2
            assert edits[bytes(named[i]) if kind == "binary" else named[i]] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    spread = [(f"{k % 7}x{k:04d}", f"text {k} of many words here") for k in range(300)]
    order = sorted(spread, reverse=True)
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.compare_with_edits(spark.createDataFrame(spread, "doc_id string, text string")).collect()}
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def test_mix_sources_is_the_queue(spark, monkeypatch):
    import corpus_pipeline as P

    for name, value in (("BUCKET_ROWS", 4), ("CELL", 2), ("RANGE_ROWS", 100)):
        monkeypatch.setattr(mixing, name, value, raising=False)
    docs = staged(table(spark, mixed_rows()).withColumn("n_chars", F.monotonically_increasing_id()))  # tells rows apart
    copies = collections.defaultdict(list)
    for r in mixing.served(docs, keep=("n_chars",)).collect():
        copies[r["n_chars"], r["copy"]].append(r)
    want = {}
    for (row, copy), own in copies.items():
        size = own[0]["size"]
        if (2 * sum(r["taken"] for r in own) >= size) if size else not copy:
            want.setdefault(row, []).append(min(r["finish_time"] for r in own))
    got = P.mix_sources(spark, docs, "").collect()
    texts = {r["n_chars"]: tuple(r) for r in docs.collect()}
    assert all(tuple(r) == texts[r["n_chars"]] for r in got)
    assert collections.Counter(r["n_chars"] for r in got) == {row: len(times) for row, times in want.items()}
    turn, times = collections.Counter(), []
    for r in got:
        times.append(sorted(want[r["n_chars"]])[turn[r["n_chars"]]])
        turn[r["n_chars"]] += 1
    assert times == sorted(times)
    assert P.mix_sources(spark, docs.limit(0), "").count() == 0


def test_mix_sources_shuffles_texts_once(spark, monkeypatch):
    """Also if the rows of the queue are too many for a broadcast."""
    import corpus_pipeline as P

    def exchanges(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return exchanges(node.initialPlan())
        below = [x for k in range(node.children().size()) for x in exchanges(node.children().apply(k))]
        return below + [node.output().mkString(",")] * (node.nodeName() == "Exchange")

    monkeypatch.setattr(P, "few", lambda df, limit=0: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.mix_sources(spark, staged(table(spark, mixed_rows())), "")._jdf.queryExecution().executedPlan()
        assert sum("text#" in x or "_doc#" in x for x in exchanges(plan)) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

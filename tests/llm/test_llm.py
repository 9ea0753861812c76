"""The operators against brute force, round trips and held-out rows, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from alertloom.llm import ann, chat, exact, language, mixing, pieces, shards, simhash, token_counts, toxicity
from alertloom.llm.queries import PIECES, QUERIES, TRICKY

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
EN = "the and of to in with hand thing other reading there which".split()
DE = "der die und das nicht eine keit schön über lichkeit heit ungen".split()

ODD_TEXTS = [
    None, "", " ", "\n", "a", " a  b ", "▁a ▁▁b", "<s>x</s> <unk>", "\x00a", "ﬁ ß 𝔘 👍🏽", "a\tb\r\n c", "12,34 (x).[y]\n\n\nz",
    "x" * 300 + "." * 200 + " " * 50, "ü" * 100, "Same Text Here Again", "same text here again", "ÄÖ same", "äö same",
]


def _docs(spark, rows, **more):
    """Documents with columns whose names clash with those that the operators add."""
    full = [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]
    df = spark.createDataFrame(full, DOCS).repartition(3)
    return df.withColumns({"kept": F.lit("own"), "ids": F.lit("own"), "score": F.lit("own"), "size": F.lit("own"), "key_id": F.lit("own")} | more)


def _awkward(spark):
    rng = random.Random(5)
    rows = [(k, t, None, None if k % 3 else f"s{k % 5}") for k, t in enumerate(ODD_TEXTS)]
    for k in range(100, 190):
        words = EN if k % 2 else DE
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))
        rows.append((k, text, "en" if k % 2 else "de", f"s{k % 5}"))
    rows += [(200 + k, "a hot group of copies that holds a third of all rows", "en", "s0") for k in range(50)]
    rows += [rows[30], rows[30], (None, rows[31][1], "en", "s1"), (None, "only without id", None, None), (None, "only without id", None, None)]
    rows.append((300, " ".join(rng.choice(EN) for _ in range(60_000)), "en", "s2"))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return _awkward(spark)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return _docs(spark, rows)


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _empty(spark):
    return spark.createDataFrame([], DOCS)


# Exact dedup


def _key(i):
    return -(2**63) if i is None else i


def test_exact_groups(rows, docs):
    found = exact.groups(docs).collect()
    assert len(found) == len(rows)
    groups: dict[str, list] = {}
    for i, text, *_ in rows:
        groups.setdefault(hashlib.sha256(_lower(text).encode()).hexdigest(), []).append(i)
    for r in found:
        own = groups[r["text_sha256"]]
        assert (r["group_size"], r["keep_id"]) == (len(own), max((i for i in own if i is not None), default=None))
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in found) == len(groups)


def test_exact_keeps_one_row_of_each(rows, docs):
    kept = exact.deduplicated(docs)
    assert kept.columns == docs.columns
    texts = [_lower(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({_lower(t) for _, t, *_ in rows})


def test_exact_runs_no_python(docs):
    plan = exact.groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# SimHash


def _fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", _lower(text).encode())
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(codes, distance):
    codes = np.array(sorted(codes), np.uint64)
    parent = list(range(len(codes)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(codes)):
        for b in (np.flatnonzero(np.bitwise_count(codes[a + 1 :] ^ codes[a]) <= distance) + a + 1).tolist():
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {int(c): top(k) for k, c in enumerate(codes.tolist())}


def test_simhash_components(rows, docs):
    prints = [_fingerprint(t) for _, t, *_ in rows]
    component = _components(set(prints), 4)
    least: dict[int, int] = {}
    for (i, *_), p in zip(rows, prints):
        if i is not None:
            least[component[p]] = min(least.get(component[p], i), i)
    want = sorted((_key(i), f"{p:016x}", _key(least.get(component[p]))) for (i, *_), p in zip(rows, prints))
    found = simhash.near_duplicates(docs).collect()
    assert sorted((_key(r["doc_id"]), r["fingerprint"], _key(r["component_id"])) for r in found) == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(component.values()))


def test_simhash_matches_spark_hash(spark):
    assert simhash.fingerprint(b"One two") == spark.sql("SELECT xxhash64('one two') AS h").first()["h"]


@pytest.mark.parametrize(("limit", "load"), [(16_384, 2_048), (64, 2_048), (300, 0.02)])
def test_index_against_all_pairs(spark, monkeypatch, limit, load):
    """Chains and one dense group; with split nodes, and with more blocks than are needed."""
    monkeypatch.setattr(simhash, "ROOT_LOAD", load)
    rng, codes = np.random.default_rng(1), set()
    for k in range(120):
        code = int(rng.integers(0, 2**64, dtype=np.uint64))
        codes.add(code)
        for _ in range(600 if k == 0 else 6 if k % 2 else 0):
            near = code
            for bit in rng.integers(0, 64, 3):
                near ^= 1 << int(bit)
            codes.add(near)
            code = code if k == 0 else near
    signed = [(int(np.uint64(c).view(np.int64)),) for c in codes]
    links = simhash.links(spark.createDataFrame(signed, "fp bigint"), 4, limit)
    groups: dict[int, set] = {}
    for r in simhash.components(links).collect():
        groups.setdefault(r["root"], {r["root"]}).add(r["member"])
    want: dict[int, set] = {}
    for code, c in _components(codes, 4).items():
        want.setdefault(c, set()).add(int(np.uint64(code).view(np.int64)))
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(random.Random(3).choice(EN) for _ in range(500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "TEXT_BLOCK", 50)
    assert simhash.fingerprint(text.encode()) == whole


# Tokens


def test_token_counts(rows, docs):
    found = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.counted(docs, PIECES).collect()}
    want = {(i, len((t or "").encode()), n := len(LIBRARY.encode(t or "")), n > 4096) for i, t, *_ in rows}
    assert found == want


def test_counts_do_not_depend_on_the_table(docs):
    none = token_counts.counted(docs, PIECES, table=token_counts.Table({}))
    assert sorted(map(str, none.collect())) == sorted(map(str, token_counts.counted(docs, PIECES).collect()))


def test_encoding_and_decoding(docs):
    found = pieces.encoded(docs.select("doc_id", "text", "ids", F.lit(1).alias("n")), PIECES)
    assert found.columns == ["doc_id", "text", "n", "ids", "decoded"]
    for r in found.collect():
        ids = LIBRARY.encode(r["text"] or "")
        assert (r["ids"], r["decoded"]) == (ids, LIBRARY.decode(ids))
    again = pieces.decoded(found.drop("decoded"), PIECES).select("decoded").collect()
    assert sorted(r["decoded"] for r in again) == sorted(r["decoded"] for r in found.collect())


def test_agenda_forms_agree():
    words = pieces.vocabulary(PIECES)
    rng = random.Random(3)
    texts = ["▁the▁▁other", "reading" * 9, "abcabcabc", "▁▁▁▁▁x", "é", "", "\x00", "👍🏽a", "x" * 64]
    texts += ["".join(rng.choice("▁thenigabcé日!") for _ in range(rng.randrange(1, 65))) for _ in range(3000)]
    assert [np.frombuffer(x, np.int32).tolist() for x in words.agendas(texts)] == list(map(words.merged, texts))
    assert words.agendas([]) == []


@pytest.mark.parametrize("cache_bytes", [0, 20_000, 40_000_000])
def test_encoder_is_the_library(cache_bytes):
    """Over all forms of white space, long segments, and a cache that overflows."""
    rng = random.Random(4)
    encoder = pieces.Encoder(pieces.vocabulary(PIECES), True, cache_bytes)
    for _ in range(6):
        texts = ["".join(rng.choice(["the", "Über", " ", "  ", "\n", "\n\n", "\t", "▁", "a" * 70, "\x00", "日本", ".", "!?" * 40]) for _ in range(rng.randrange(60))) for _ in range(200)]
        texts += [" ".join(EN) * 3, "Übermut tut selten gut.", "", " ", "a ", " \n a", *filter(None, ODD_TEXTS)]
        assert [x.tolist() for x in encoder(texts)] == LIBRARY.encode(texts)
        assert encoder.held <= cache_bytes and encoder.held >= sum(len(k) + len(v) for k, v in encoder.cache.items())


# Language


def test_language(rows, docs):
    found = {(r["doc_id"], r["text"]): r for r in language.predicted(docs.drop("score"), language.train(docs)).collect()}
    for i, text, lang, _ in rows:
        r = found[i, text]
        assert 0 <= r["score"] <= 1
        if not re.search(r"[^\W\d_]", text or ""):
            assert r["lang_pred"] == "und"
        elif lang and len(text) > 60:
            assert r["lang_pred"] == lang
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and kept.count() >= 140


def test_language_windows(monkeypatch):
    texts = ["hello there", "x" * 50, ""]
    one = [np.sort(b).tolist() for b, _ in language.buckets([texts[1]])]
    monkeypatch.setattr(language, "WINDOW", 7)
    many = np.sort(np.concatenate([b for b, _ in language.buckets([texts[1]])])).tolist()
    assert sum(one, []) == many


def _grams(text):
    """Hashed n-grams of a text, one by one."""
    codes = list(map(ord, f" {text.lower()} "))
    for n in language.GRAMS:
        for k in range(len(codes) - n + 1):
            h = n
            for c in codes[k : k + n]:
                h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            yield h % language.BUCKETS


def test_language_is_naive_bayes(spark):
    """Posteriors equal those of plain counting, over all rows that may be learned from, repeated rows included."""
    rng = random.Random(12)
    words = {"en": EN, "de": DE, "xx": ["aba", "bab", "ü"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 8))), lang, "s") for k in range(120) for lang in [rng.choice(list(words))]]
    rows += [rows[4], rows[4], (500, None, "en", "s"), (501, "", "de", "s"), (502, "the 1", None, "s"), (None, "der die das", "de", "s")]
    learned = [r for r in rows if r[2] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    langs = sorted({r[2] for r in learned})
    counts = {lang: np.full(language.BUCKETS, language.SMOOTHING) for lang in langs}
    for _, text, lang, _ in learned:
        for gram in _grams(text or ""):
            counts[lang][gram] += 1
    prior = {lang: sum(r[2] == lang for r in learned) / len(learned) for lang in langs}
    found = language.predicted(_docs(spark, rows).drop("score"), language.train(_docs(spark, rows)))
    asked = ["the and", "ungen", "aba", "Über die hand", "z"]
    more = language.predicted(_docs(spark, [(k, t, None, None) for k, t in enumerate(asked)]).drop("score"), language.train(_docs(spark, rows)))
    for r in [*found.collect(), *more.collect()]:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = {lang: np.log(prior[lang]) + sum(np.log(counts[lang][g] / counts[lang].sum()) for g in _grams(r["text"])) for lang in langs}
        top = max(logs.values())
        best = min(lang for lang in langs if logs[lang] == top)
        assert r["lang_pred"] == best
        assert r["score"] == pytest.approx(1 / sum(np.exp(v - top) for v in logs.values()), abs=1e-4)


def test_learns_nothing_from_held_out(spark):
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2][:20]
    assert language.train(_docs(spark, [(k, "the and", "en", "s") for k in held])) is None
    found = language.predicted(_docs(spark, [(1, "the and", "en", "s")]).select("doc_id", "text"), None).first()
    assert (found["lang_pred"], found["score"]) == ("und", 0.0)


# Sharding


def test_shards(rows, docs):
    found = shards.sharded(docs).toPandas()
    assert len(found) == len(rows)
    size = {(_key(i), zlib.crc32((t or "").encode())): len((t or "").encode()) + 8 for i, t, *_ in rows}
    keys = list(zip(found["doc_id"].map(lambda i: -(2**63) if np.isnan(i) else int(i)), found["text_crc32"]))
    assert [size[k] for k in keys] == found["size"].tolist()
    assert (found.groupby("text_crc32")["shard"].nunique() == 1).all()
    for _, slots in found.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


@pytest.mark.parametrize("count", [3, 8])
def test_capacity_is_the_smallest(spark, count):
    rng = random.Random(count)
    groups = sorted((hashlib.sha256(str(k).encode()).hexdigest(), rng.randrange(1, 1000)) for k in range(600))
    starts = shards._partition(spark.createDataFrame([(g, s, 1) for g, s in groups], "text_sha256 string, size bigint, copies int"), count)
    assert len(starts) == count - 1
    loads = [0] * count
    for g, s in groups:
        loads[sum(g >= x for x in starts)] += s
    best = [0] + [10**9] * len(groups)  # the least capacity for the first n groups, shard by shard
    sums = np.cumsum([0] + [s for _, s in groups])
    for _ in range(count):
        best = [0] + [min(max(best[m], int(sums[n] - sums[m])) for m in range(n)) for n in range(1, len(groups) + 1)]
    assert max(loads) == best[-1]


# Mixing


def test_targets_share_what_is_left_over():
    wanted = mixing.targets([("a", 10), ("b", 1000), (None, 500)])
    assert wanted["a"] == 20.0 and wanted[None] == 1000.0 and sum(wanted.values()) == 1.5 * 1510


def test_flow_prefers_fewer_repetitions():
    patterns = [(("a",), 100), (("a", "b"), 100), (("b",), 100)]
    given = mixing.routed(patterns, {"a": 150, "b": 150})
    assert sum(g.get("a", 0) for g in given) == 150 and sum(g.get("b", 0) for g in given) == 150
    assert [sum(g.values()) for g in given] == [100, 100, 100]


def test_mix(rows, docs):
    found = mixing.mixed(docs, F.array("source")).toPandas()
    assert len(found) == len(rows) and (found["taken"] <= 2 * found["size"]).all()
    again = mixing.mixed(docs.repartition(5), F.array("source")).toPandas()
    order = ["doc_id", "size", "taken"]
    assert sorted(map(str, found[order].values.tolist())) == sorted(map(str, again[order].values.tolist()))
    own = found.assign(source=[str(p) for p in found["pattern"]]).groupby("source").agg(
        size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max")
    )
    assert (own["size"] == own["source_size"]).all()
    assert ((own["taken"] - own["target"]).abs() <= own["most"] / 2 + 1).all()
    assert mixing.resampled(docs).columns == docs.columns


# Toxicity


@pytest.fixture(scope="module")
def toxic_model(spark):
    rng, texts, labels = random.Random(2), [], []
    for k in range(600):
        words = [rng.choice(EN) for _ in range(30)]
        bad = k % 5 == 0
        if bad:
            words[3:3] = rng.sample(["idiot", "moron", "stupid", "scum"], 2)
        texts.append((k, " ".join(words), "en", "s"))
        labels.append((k, 1, int(bad)))
    labels += [(None, 1, 1), (601, None, None), (602, 0, 1)]
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return toxicity.train(_docs(spark, texts), frame)


def test_toxic_words_in_disguise(spark, toxic_model):
    plain, bad = ["the and of", "", None, "1234 the", "reading hand"], ["an IDIOT!!", "1d10t", "the m o r o n of", "stuuuupid", "$cum", "i.d.i.o.t"]
    docs = _docs(spark, [(k, t, None, None) for k, t in enumerate(plain + bad)])
    found = {r["doc_id"]: r for r in toxicity.scored(docs, toxic_model).collect()}
    assert [found[k]["predicted"] for k in range(len(found))] == [0] * len(plain) + [1] * len(bad)
    assert found[1]["score"] == found[2]["score"]
    restored = {r["doc_id"]: r["restored"] for r in toxicity.restored(docs, toxic_model).collect()}
    assert restored[6] == "idiot" and restored[8] == "stupid"


def test_toxic_words_among_others(spark, toxic_model):
    """Words are found in runs of several words, in mixed tokens, and in tokens and runs of any length."""
    bad = ["the a m o r o n", "t h e r e s t u p i d", "the,idiot", "of/stupid", "the;idiot", "st" + "u" * 200 + "pid", "m  o  r  o  n", "m\to\tr\to\tn",
           "t h e  i d i o t", "the " * 3 + " ".join("the" * 45) + " s t u p i d", "m, o, r, o, n"]
    docs = _docs(spark, [(k, t, None, None) for k, t in enumerate(bad)])
    found = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, toxic_model).collect()}
    assert [t for k, t in enumerate(bad) if not found[k]] == []


def test_characters_of_all_texts(spark):
    """Words of unlabelled rows are in the character model, whatever the sample, in any script."""
    docs = _docs(spark, [(1, "the and", "en", "s"), (2, "the", "en", "s"), (3, "\u0436\u0443\u043a \u6f22\u5b57", "ru", "s"), (4, "x" * 70, "en", "s"), (5, None, None, None)])
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int"), limit=1).characters
    at = lambda gram: model.counts[toxicity._place(0, gram)]
    assert at("^\u0436\u0443") == 1 and at("^\u6f22\u5b57") == 1 and at("xxx") == 68 and at("^th") == 2


def test_counted_characters():
    """Against counting words one by one."""
    text = " (the) don't \"und,\" a1b x  $$$ über!!! \t\n日本語 e_f ...a... 12 " + "the " * 50 + "\u2003end"
    want = np.zeros(toxicity._STARTS[-1], np.int64)
    for token in text.split():
        word = token.strip(toxicity._AROUND)
        if word.isalpha():
            padded = f"^^{word}$"
            for k in range(len(padded) - 2):
                a, b, c = padded[k : k + 3]
                for table, gram in enumerate((a + b + c, b + c, c, a + b, b)):
                    want[toxicity._place(table, gram)] += 1
    assert (toxicity.counted_characters(text) == want).all() and want.sum() > 0
    assert not toxicity.counted_characters("").any() and not toxicity.counted_characters(" 1 ").any()


@pytest.fixture(scope="module")
def characters():
    text = " ".join(EN + DE + ["idiot", "moron", "stupid", "scum", "assess", "lilli", "zoo"]) * 7
    return toxicity.Characters(toxicity.counted_characters(text))


def _paths(model, signs):
    """Every way through a lattice: (score, letters)."""
    paths = [(0.0, "^^", "")]
    for sign in signs:
        after = []
        letters = [(sign, toxicity.PLAIN)] if sign.isalpha() else [(c, toxicity.LOOK_ALIKE) for c in toxicity.LOOKS_LIKE.get(sign, "")]
        for score, state, text in paths:
            after += [(score + cost + model.log(state, c), state[1] + c, text + c) for c, cost in letters]
            if sign in toxicity.SEPARATORS or not letters:
                after.append((score + toxicity.SKIPPED, state, text))
            if any(c == state[1] for c, _ in letters):
                after.append((score + toxicity.REPEATED, state, text))
        paths = after
    return [(score + model.log(state, "$"), text) for score, state, text in paths]


def test_viterbi_finds_the_best_of_all_paths(characters):
    rng = random.Random(9)
    for _ in range(300):
        signs = "".join(rng.choice("thenio01!|$.-l1s5tt") for _ in range(rng.randrange(1, 10)))
        found = _paths(characters, signs)
        best = max(found)[0]
        assert max(score for score, text in found if text == characters.decoded(signs)) == pytest.approx(best, abs=1e-9), signs


def test_segmentation_is_that_of_all_cuts(characters):
    rng = random.Random(10)
    own = lambda w: sum(characters.log(p[k : k + 2], p[k + 2]) for p in [f"^^{w}$"] for k in range(len(w) + 1))
    for _ in range(100):
        letters = "".join(rng.choice("theindo") for _ in range(rng.randrange(1, 10)))
        every = []
        for cuts in range(1 << (len(letters) - 1)):
            words = [""]
            for k, c in enumerate(letters):
                words[-1] += c
                if k < len(letters) - 1 and cuts >> k & 1:
                    words.append("")
            every.append((sum(map(own, words)), words))
        best = max(every)[0]
        found, near = characters.words(letters)
        assert "".join(found) == letters and sum(map(own, found)) == pytest.approx(best, abs=1e-9)
        assert set(near) == {w for score, words in every if score >= best - toxicity.MARGIN for w in words}


def test_regression_is_the_dense_one():
    rng = np.random.default_rng(5)
    x = rng.random((400, 12)) < 0.2
    y = (rng.random(400) < 1 / (1 + np.exp(2 - 3 * x[:, 0] - 2 * x[:, 1]))).astype(int)
    w, bias = toxicity._fitted([(int(t), np.flatnonzero(r).tolist()) for t, r in zip(y, x)], list(range(12)))
    full, penalty, v = np.column_stack([x, np.ones(400)]).astype(float), np.append(np.full(12, toxicity.PENALTY), 1e-6), np.zeros(13)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ v))
        v -= np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty), full.T @ (p - y) + penalty * v)
    assert np.allclose(np.append(w, bias), v, atol=1e-6)


def test_words_that_stand_as_they_are_give_none_inside(characters):
    harmless = "grape-fruit cockpit-door therapist-led can't don't http://www.example.com/some-page_1 (cockpit) scunthorpe! class$$$ x=assess; 1st"
    inside = {"rape", "cock", "rapist", "cunt", "ass", "tit"}
    for token in harmless.split():
        assert inside.isdisjoint(toxicity._readings(token, characters)), token
    assert "idiot" in set(toxicity._readings("the1d10t", characters)) and "stupid" in set(toxicity._readings("$tupid!", characters))


def test_long_tokens_take_linear_time(characters):
    for token in ("ab3+/9x1k0", "a.b.c", "1!|", "x"):
        took = []
        for times in (500, 4000):
            began = time.process_time()
            assert sum(1 for _ in toxicity._readings(token * times, characters))
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0] + 0.5, token


def test_toxicity_without_labels(spark, docs):
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.scored(docs, model).select("score").distinct().count() == 1


# Chat


def _record(layout):
    a, b = TRICKY, "x \\</s> <\\s> [\\\\INST] ok"
    return {
        "messages": {"messages": [{"role": "user", "content": a}, {"role": "assistant", "content": b}], "extra": {"z": 1}},
        "from_value": {"conversations": [{"from": "human", "value": a}, {"from": "gpt", "value": b}]},
        "turns": {"id": 3, "turns": [{"role": "user", "text": a}, {"role": "bot", "text": b}]},
        "instruction": {"instruction": a, "output": b},
        "prompt_completion": {"prompt": a, "completion": b},
        "prompt_response": {"prompt": a, "response": b},
        "nested_prompt": {"prompt": {"user": a}, "response": {"text": b}},
        "question_answer": {"question": a, "answer": b, "tags": []},
    }[layout], [("user", a), ("assistant", b)]


def test_turn_rows(spark):
    """One row per turn, none of records without turns; the parsed record is looked at once."""
    records = [(1, json.dumps({"role": "bot", "text": "a"})), (2, None), (3, "{"), (4, json.dumps({"messages": []})),
               (5, json.dumps({"messages": [{"role": "user", "content": "b"}, {"role": None, "content": None}]}))]
    rows = chat.turn_rows(chat.canonical(spark.createDataFrame(records, "k int, record string")))
    assert {tuple(r) for r in rows.select("k", "within", "role", "text").collect()} == {
        (1, 0, "assistant", "a"), (5, 0, "user", "b"), (5, 1, "", ""),
    }
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def test_layouts(spark):
    names = [x.name for x in chat.LAYOUTS if x.name not in ("turn_row", "instruction_input")]
    records = [(n, json.dumps(_record(n)[0])) for n in names]
    records += [("bad", "{"), ("null", None), ("other", '{"a": 1}'), ("empty", '{"messages": []}')]
    found = {r["name"]: r for r in chat.canonical(spark.createDataFrame(records, "name string, record string")).collect()}
    for n in names:
        assert (found[n]["layout"], [tuple(t) for t in found[n]["turns"]]) == (n, _record(n)[1])
    for n in ("bad", "null", "other", "empty"):
        assert found[n]["layout"] is None and found[n]["turns"] == []


def test_long_texts(spark, tmp_path):
    """Texts beyond the JSON parser's 20,000,000 characters are read, from JSON and from columns; what is not read is reported."""
    long = 20_100_000
    text = F.expr(f"repeat('a', {long})")
    rows = spark.range(1).select(F.lit("human").alias("role"), text.alias("text"))
    records = rows.select(F.lit("long").alias("k"), F.to_json(F.struct("role", "text")).alias("record"))
    more = spark.createDataFrame([("bad", "{"), ("other", '{"a": 1}'), ("null", None)], records.schema)
    found = chat.canonical(records.unionByName(more))
    for turns in (chat.turn_rows(found), chat.turn_rows(chat.canonical_columns(rows, ("role", "text")))):
        assert [tuple(r) for r in turns.select("role", F.length("text")).collect()] == [("user", long)]
    assert {(r["k"], r["problem"]) for r in chat.unread(found).collect()} == {("bad", "unparsed"), ("other", "no layout")}
    table = spark.range(1).select(F.lit(7).alias("conv_id"), F.lit(0).alias("turn"), F.lit("gpt").alias("role"), text.alias("text"))
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r["conv_id"]: r["loss_chars"] for r in QUERIES["op3_chat_formatting"](spark, str(tmp_path)).collect()} == {7: long, -1: len(TRICKY)}


def test_columns_and_json_agree(spark):
    for name in (x.name for x in chat.LAYOUTS if x.name not in ("turn_row", "instruction_input")):
        record = json.dumps(_record(name)[0])
        schema = spark.range(1).select(F.schema_of_json(F.lit(record))).first()[0]
        rows = spark.createDataFrame([(record,)], "record string").select(F.from_json("record", schema).alias("r")).select("r.*")
        found = chat.canonical_columns(rows, rows.columns).first()
        assert (found["layout"], [tuple(t) for t in found["turns"]]) == (name, _record(name)[1])


def test_template_is_reversible(spark):
    rng, signs = random.Random(4), ["<", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<|turn|>", "<|text|>", "a", "\n", "s>", "|", "é"]
    rows = [(k, rng.choice(["user", "assistant", "<|text|>", ""]), "".join(rng.choices(signs, k=rng.randrange(12)))) for k in range(400)]
    found = chat.read_back(chat.rendered(spark.createDataFrame(rows, "k int, role string, text string"))).collect()
    for r in found:
        k, role, text = rows[r["k"]]
        assert (r["role"], r["text"], r["loss_text"]) == (role, text, text if role == "assistant" else None)
        assert all(r["formatted"].count(c) == (c in (chat.OPEN, chat.ROLE_END, chat.CLOSE)) for c in chat.CONTROL)


# Neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    rows += [(1000 + k, rows[0][1]) for k in range(150)] + [rows[5], rows[5]]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [1.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"rank": F.lit(1), "key": F.lit("x")})
    good = {i: np.array(v) for i, v in rows if i is not None and i < 2000}
    hits = total = 0
    by_query: dict[int, list] = {}
    for r in ann.nearest_neighbours(frame).orderBy("query_id", "rank").collect():
        by_query.setdefault(r["query_id"], []).append(r)
    assert sorted(by_query) == sorted(i for i in good if i % 20 == 0)
    for q, found in by_query.items():
        want = sorted(((-(good[q] * v).sum(), i) for i, v in good.items() if i != q))[:20]
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(abs(r["score"] - (good[q] * good[r["vec_id"]]).sum()) < 1e-12 for r in found)
        assert found == sorted(found, key=lambda r: (-r["score"], r["vec_id"]))
        hits, total = hits + len({i for _, i in want} & {r["vec_id"] for r in found}), total + 20
    assert hits >= 0.9 * total


def test_few_vectors(spark):
    rows = [(k, [float(k + 1), 1.0]) for k in range(5)]
    found = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted(r["vec_id"] for r in found) == [1, 2, 3, 4]


def test_queries_read_a_share_of_the_files(spark, monkeypatch):
    """With many pivots to a vector's length, a query still meets what is near to it."""
    monkeypatch.setattr(ann, "LENGTH", 3)
    monkeypatch.setattr(ann, "PIVOTS_PER_ROOT", 3)
    base = np.random.default_rng(8).normal(size=(3000, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(base)], "vec_id bigint, embedding array<double>")
    found: dict[int, set] = {}
    for r in ann.nearest_neighbours(frame, step=60).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found.get(q, set()) & set(np.argsort(-(base @ base[q]))[1:21].tolist())) for q in range(0, 3000, 60))
    assert hits >= 0.9 * 20 * 50


# Everything


def test_empty_tables(spark):
    docs = _empty(spark)
    for found in (
        exact.groups(docs), exact.deduplicated(docs), simhash.near_duplicates(docs), simhash.deduplicated(docs),
        token_counts.counted(docs, PIECES), pieces.encoded(docs, PIECES), language.accepted(docs), shards.sharded(docs),
        mixing.mixed(docs, F.array("source")), mixing.resampled(docs),
        ann.nearest_neighbours(spark.createDataFrame([], "vec_id bigint, embedding array<float>")),
        toxicity.scored(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))),
    ):
        assert found.count() == 0


def test_pipeline(spark, rows, docs):
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, "")
        assert at.columns == docs.columns, name
    assert before.count() > 20
    last = corpus_pipeline.STAGES[-1][1](spark, at, "")
    for r in last.select("ids", "n_tokens", "ids_sha256").collect():
        assert (r["n_tokens"], r["ids_sha256"]) == (len(r["ids"]), hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest())


def test_all_are_registered():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES] == list(range(1, 14))

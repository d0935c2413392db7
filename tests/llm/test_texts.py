"""Tokenizer, leak search and language identification: against libraries, planted cases, held-out accuracy, edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetcube.llm import bpe, language, leaks
from facetcube.llm.codes import Codes, Table, span_hashes, uniques
from facetcube.llm.queries import TOKENIZERS

DATA = "/root/testdata/sf0.01"
DOCUMENTS = "doc_id bigint, text string, lang string, ids string, key int, label string"
HARD = [None, "", " ", "\n\n", "a", "\0", "﻿", "�", "<|endoftext|>", "𝒜🎉" * 50, "x" * 30_000, "it's 'sss 's' 'LL''ll", "ab " * 20_000, "\n\n\n\na\n\n\n", "e\u0301" * 40, "&&;;&;<<>><b", "مرحبا שלום ไทย हिन्दी"]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, None, "x", 1, "y") for i, t in enumerate(HARD)]
    return spark.createDataFrame([*rows, rows[3], (None, "the device with the lever", "en", None, None, None)], DOCUMENTS)


# --- arrays of code points


def test_codes_know_their_texts():
    c = Codes(pa.array(["aé", None, "", "日本🎉"], pa.string()).slice(0))
    assert c.starts.tolist() == [0, 2, 2, 2, 5] and "".join(map(chr, c.codes)) == "aé日本🎉" and c.slice(2, 4).decode() == "日本"
    c = Codes(pa.array(["skip", "aé", "b"], pa.string()).slice(1))
    assert c.starts.tolist() == [0, 2, 3] and c.slice(1, 3).decode() == "éb"
    assert Codes(pa.array([], pa.string())).starts.tolist() == [0]


def test_equal_spans_have_equal_hashes():
    x = np.array([1, 2, 3, 1, 2, 3, 4])
    h = span_hashes(x, np.array([0, 3, 3, 0]), np.array([3, 6, 7, 0]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3
    number, different, first = uniques(h)
    assert number.tolist() == [0, 0, 1, 2] and first.tolist() == [0, 2, 3] and different.tolist() == h[first].tolist()


# --- tokenizer


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(f"{TOKENIZERS}/byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def encode(vocabulary, texts):
    return bpe.Encoder(vocabulary).encode(Codes(pa.array(texts, pa.string()))).to_pylist()


def expected(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoding_of_documents(vocabulary, library):
    texts = pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist()
    assert encode(vocabulary, texts) == expected(library, texts)


def test_encoding_of_hard_texts(vocabulary, library):
    assert encode(vocabulary, HARD) == expected(library, HARD)
    assert encode(vocabulary, [None, ""]) == [[], []] and encode(vocabulary, []) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab's'lr ve\n\t 1²é漢", max_size=60)), max_size=5))
def test_encoding_of_anything(vocabulary, library, texts):
    assert encode(vocabulary, texts) == expected(library, texts)


def test_forgetting_changes_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    e, texts = bpe.Encoder(vocabulary), [f"word{i} and other{i % 7}" for i in range(200)]
    got = [x for s in range(0, 200, 20) for x in e.encode(Codes(pa.array(texts[s : s + 20]))).to_pylist()]
    assert got == expected(library, texts)


def test_encoding_in_spark(spark, hard, vocabulary, library):
    rows = bpe.encode_texts(hard, vocabulary).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in rows) == sorted((d is None, d or 0, ids) for (d, ids) in zip([r.doc_id for r in hard.collect()], expected(library, [r.text for r in hard.collect()]), strict=True))
    assert bpe.encode_texts(hard.limit(0), vocabulary).count() == 0


# --- leaks


@pytest.fixture(scope="module")
def items():
    t = pq.read_table(f"{DATA}/eval_items.parquet").to_pydict()
    return dict(zip(t["item_id"], t["text"], strict=True))


@pytest.fixture(scope="module")
def index(items):
    return leaks.Index.build(list(items), list(items.values()))


def found(index, texts):
    out = {}
    for text, item, *_ in leaks.leaks_of(index, Codes(pa.array(texts, pa.string()))):
        out.setdefault(text, set()).add(index.ids[item])
    return [out.get(i, set()) for i in range(len(texts))]


FILLER = "The known device has a lever 12 which is fixed to the housing by means of a spring and is heated before use. "
LOOK = str.maketrans("aeopcx", "аеорсх")


def passages(items, seed=1):
    rng = random.Random(seed)
    for item, text in rng.sample(sorted(items.items()), 25):
        words = text.split()
        n = len(words)
        half = words[: n // 2]
        a, b = words[: n // 4 + 2], words[-(n // 4 + 2) :]
        edited = list(words)
        for i in range(3, n - 3, 7):
            edited[i] = rng.choice(["ladder", "copper", "device"])
        yield item, {
            "whole": text, "half": " ".join(half), "upper": text.upper(), "bare": re.sub(r"\W+", " ", text), "split": re.sub(r"(\w{3})(\w{3})", "\\1-\n\\2", text),
            "joined": "".join(half), "spaced": " ".join(text), "invisible": re.sub(r"(\w)(\w)", "\\1\u200b\\2", text), "markup": re.sub(r"(\w{5,})", "<b>\\1</b>", text).replace(" ", "&nbsp;"),
            "look": text.translate(LOOK), "garbled": text.encode().decode("cp1252", "ignore"), "two": " ".join(a) + ". " + FILLER * 12 + " ".join(b), "edited": " ".join(edited),
        }


def test_planted_passages_are_found(items, index):
    for item, forms in passages(items):
        got = found(index, [f"{FILLER * 3}{p} {FILLER * 3}" for p in forms.values()])
        assert {k for k, g in zip(forms, got, strict=True) if g != {item}} == set()


def test_less_is_not_found(items, index):
    rng = random.Random(3)
    for _, text in list(items.items())[:40]:
        words = text.split()
        shuffled = rng.sample(words, len(words))
        changed = [rng.choice(["ladder", "copper", "device"]) if i % 3 == 0 else w for i, w in enumerate(words)]
        texts = [" ".join(words[: len(words) // 4]), " ".join(shuffled), " ".join(changed), FILLER * 30]
        assert found(index, [FILLER + t + " " + FILLER for t in texts]) == [set()] * 4


def two_fifths(words, share, edited, rng):
    """Two fifths of the words in stretches of ``share`` and the rest, far apart, each sixth word changed if ``edited``."""
    n = len(words)
    k = -(-2 * n // 5)
    first = round(k * share)
    s = rng.randrange(n - k + 1)
    u = rng.randrange(s + first, n - (k - first) + 1)
    at, left = rng.randrange(6), k // 6
    parts = []
    for x in (words[s : s + first], words[u : u + k - first]):
        for i in range(len(x)):
            at += 1
            if edited and at % 6 == 0 and left:
                x[i], left = rng.choice(["ladder", "copper", "device"]), left - 1
        parts.append(" ".join(x))
    return f"{FILLER * 14}{parts[0]} {FILLER * 14}{parts[1]} {FILLER * 14}"


@pytest.mark.parametrize(("share", "edited", "least"), [(1, False, 1), (0.5, False, 1), (0.75, False, 1), (0.8, False, 1), (0.2, False, 1), (1, True, 0.9), (0.5, True, 0.85), (0.75, True, 0.75), (0.8, True, 0.7)])
def test_two_fifths_are_found(items, index, share, edited, least):
    rng, some = random.Random(5), sorted(items.items())[::4]
    got = found(index, [two_fifths(text.split(), share, edited, rng) for _, text in some])
    assert all(g <= {i} for (i, _), g in zip(some, got, strict=True))
    assert sum(map(len, got)) >= least * len(some)


def test_pruning_loses_no_candidate(index):
    texts = pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist()[:300]
    c = Codes(pa.array(texts, pa.string()))
    f = leaks.folded(c)
    got = {(t, i) for t, i, _ in leaks.candidates(index, c, f)}
    plain = set()
    for t in range(len(texts)):
        own = f[c.starts[t] : c.starts[t + 1]]
        g = leaks.grams(own[own > 0])
        half = leaks.WINDOW // 2
        best, whole = np.zeros(len(index.ids)), np.zeros(len(index.ids))
        windows = [set(g[max(s - half, 0) : s + half].tolist()) for s in range(0, len(g) + half, half)] + [set(g.tolist())]
        for k, w in enumerate(windows):
            score = np.zeros(len(index.ids))
            for x in w:
                at = np.searchsorted(index.terms, x)
                if at < len(index.terms) and index.terms[at] == x:
                    rows = slice(index.post_start[at], index.post_start[at + 1])
                    score[index.post_item[rows]] += index.post_impact[rows]
            if k == len(windows) - 1:
                whole = score
            else:
                best = np.maximum(best, score)
        plain |= {(t, int(i)) for i in np.flatnonzero((best >= index.least) & (whole >= index.least * leaks.WHOLE / leaks.SHARE))}
    assert got == plain and plain


def test_leaks_in_spark(spark, hard, items, index):
    text = items[1]
    docs = spark.createDataFrame([(7, text, None, None, None, None), (8, text, None, None, None, None), (None, text, None, None, None, None)], DOCUMENTS).unionByName(hard)
    rows = leaks.find_leaks(docs, index).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in rows) == [(0, 1), (7, 1), (8, 1)] and all(r.contained == 1 and r.edits == 0 for r in rows)
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "??")], "item_id bigint, text string")
    assert leaks.find_leaks(docs, leaks.index_of(empty)).count() == 0
    assert leaks.find_leaks(docs, leaks.index_of(empty.limit(0))).count() == 0
    with pytest.raises(ValueError, match="held-out"):
        leaks.index_of(empty, most=1)


# --- languages


@pytest.fixture(scope="module")
def samples():
    t = pq.read_table(f"{DATA}/lang_samples.parquet").to_pydict()
    return list(zip(t["lang"], t["text"], strict=True))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]


@pytest.fixture(scope="module")
def model(samples, pieces):
    return language.fit(samples, pieces)


def guess(model, texts):
    text, par, total, _, own = language.paragraphs(language.Words.read(Codes(pa.array(texts, pa.string())), language.Scorer(model)))
    return {(int(t), int(p)): language.LANGS[i] for t, p, i, o in zip(text, par, total[:, :-1].argmax(axis=1), own, strict=True) if o}


def test_held_out_accuracy(samples, pieces):
    rng = random.Random(0)
    mixed = rng.sample(samples, len(samples))
    train, test = mixed[: len(mixed) // 2], mixed[len(mixed) // 2 :]
    got = guess(language.fit(train, pieces), [t for _, t in test])
    assert np.mean([got.get((i, 0)) == lang for i, (lang, _) in enumerate(test)]) > 0.97


def test_forward_sums_all_segmentations(model):
    def brute(word, lang):
        ways = [1.0] + [0.0] * len(word)
        for i in range(1, len(word) + 1):
            for k in range(max(0, i - language.LONGEST_PIECE), i):
                p = prob(word[k:i], lang)
                ways[i] += ways[k] * p
        return ways[-1]

    def prob(piece, lang):
        h = span_hashes(np.array([ord(x) for x in piece], np.int64), np.array([0]), np.array([len(piece)]))[0]
        at = np.searchsorted(model.hashes, h)
        if at < len(model.hashes) and model.hashes[at] == h:
            return model.probs[at, lang]
        return model.unknown[language.LATIN, lang] if len(piece) == 1 else 0.0

    for word in ("device", "vorrichtung", "qþx"):
        c = Codes(pa.array([word]))
        low, s, e, kind, _ = language.words_of(c)
        got = model.score(language.rows_of(low, s, e, kind), kind)[0]
        assert got == pytest.approx([np.log(brute("▁" + word, i)) for i in range(9)])
    assert model.probs.sum(axis=0) == pytest.approx(np.ones(9), abs=0.02)


def test_paragraphs(model, samples):
    by = {}
    for lang, t in samples:
        by.setdefault(lang, t)
    text = f"{by['de']}\n{by['de']}\n\n\n{by['fr'].upper()}\n\n12 + 34 = 46\n\n{by['ja']} [the lever]\n\n{by['zh']}"
    assert guess(model, [text, "", None, "\n\n" + by["ru"], "x² = 4·a / �", "15a C10H22O2", by["it"]]) == {(0, 0): "de", (0, 1): "fr", (0, 3): "ja", (0, 4): "zh", (3, 1): "ru", (6, 0): "it"}


def test_labels():
    named = {"en": "en", "EN": "en", "en_GB": "en", "eng": "en", "English": "en", "zh-Hans": "zh", "chi": "zh", "zho": "zh", "GER": "de", "fre": "fr", "pt-BR": "pt", "Chinese (simplified)": "zh", "": None, None: None, "xx": None, "und": None, "n/a": None, "bg": None, " ja ": "ja"}
    assert {k: language.label_names(k) for k in named} == named


def test_languages_in_spark(spark, hard, model, samples):
    by = {}
    for lang, t in samples:
        by.setdefault(lang, t)
    rows = [(100, f"{by['en']}\n\n{by['en']}\n\n{by['es']}", "en-US"), (101, by["pt"], "Spanish"), (102, by["it"], None), (103, by["de"], "DEU")]
    docs = spark.createDataFrame([(i, t, lang, None, None, None) for i, t, lang in rows], DOCUMENTS).unionByName(hard)
    got = {tuple(r) for r in language.wrong_labels(language.identify(docs, model)).select("doc_id", "par_no", "lang").collect()}
    assert {g for g in got if g[0] and g[0] >= 100} == {(100, 2, "es"), (101, -1, "pt"), (102, -1, "it")}
    every = language.identify(docs, model)
    assert every.filter("confidence < 0 or confidence > 1 or confidence is null").count() == 0
    assert every.filter("doc_id in (0, 1, 2, 3)").count() == 0 and language.identify(docs.limit(0), model).count() == 0


def test_a_single_word_has_a_language(model):
    assert guess(model, ["Verfahren", "x = 5", "", "Der Hund", "압력을 측정하는", "阀门", "The\n\n7 m"]).keys() == {(0, 0), (3, 0), (5, 0), (6, 0)}
    assert guess(model, ["Verfahren"])[0, 0] == "de"


def test_none_of_these(spark, model):
    texts = ["이 발명은 압력을 측정하는 장치에 관한 것이다", "Ten wynalazek dotyczy urządzenia do pomiaru ciśnienia w przewodzie", "The known devices have the disadvantage that they are expensive"]
    docs = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "doc_id bigint, lang string, text string")
    rows = {(r.doc_id, r.par_no): r for r in language.identify(docs, model).collect()}
    assert rows[0, -1].lang is None and rows[0, 0].none > 0.99 and rows[1, 0].none > 0.9 and rows[2, 0].lang == "en" and rows[2, 0].confidence > 0.9
    assert {r.doc_id for r in language.wrong_labels(language.identify(docs, model)).collect()} == {1, 2}


def test_confidence_is_right_as_often_as_it_says(samples, pieces):
    fitted = language.fit([x for i, x in enumerate(samples) if i % 3], pieces, rounds=3)
    rest = samples[::3]
    fitted.tempering = language.temper(fitted, rest[::2])
    for k in (1, 3, 8):
        runs = []
        for lang, text in rest[1::2]:
            words = [text[i : i + 2] for i in range(0, len(text), 2)] if lang in ("zh", "ja") else text.split()
            glue = "" if lang in ("zh", "ja") else " "
            runs += [(lang, glue.join(words[i : i + k])) for i in range(0, len(words) - k + 1, k)]
        text, _, total, words, _ = language.paragraphs(language.Words.read(Codes(pa.array([t for _, t in runs])), language.Scorer(fitted)))
        chance, best = fitted.posterior(total, words), total[:, :-1].argmax(axis=1)
        right = np.mean([language.LANGS[b] == runs[t][0] for b, t in zip(best, text, strict=True)])
        assert abs(right - chance[np.arange(len(best)), best].mean()) < 0.06


def test_mixed_paragraphs_are_cut(spark, model, monkeypatch):
    en, de = "The known devices have the disadvantage that they are expensive to manufacture.", "Das Gehäuse ist mit einem Deckel versehen, der sich leicht abnehmen lässt."
    texts = [f"{en} {de}", f"{en}\n\n{de}", f"{de} {en} {de}", en, None, "", "7"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = sorted(language.mixed(docs, model).collect())
    assert [(r.doc_id, r.par_no, r.seg_no, r.lang) for r in rows] == [(0, 0, 0, "en"), (0, 0, 1, "de"), (2, 0, 0, "de"), (2, 0, 1, "en"), (2, 0, 2, "de")]
    for r in rows:
        cut = texts[r.doc_id][r.begins : r.ends]
        assert abs(len(cut) - (len(en) if r.lang == "en" else len(de))) < 30 and r.confidence > 0.9
    w = language.Words.read(Codes(pa.array([f"{en} {de} " * 3])), language.Scorer(model))
    whole = [x.tolist() for x in language.segments_of(w)]
    monkeypatch.setattr(language, "WORDS_A_PATH", 30)
    assert [x.tolist() for x in language.segments_of(w)][1] == whole[1]
    assert language.mixed(docs.limit(0), model).count() == 0


def test_markup_of_any_length(items, index):
    item, text = min(items.items())
    words = text.split()
    link = '<a href="https://example.org/some/long/address?with=parameters&more=of&them=all" class="reference external">'
    marked = " ".join(f"{link}{w}</a> <!-- changed by the editor --> <br/>" if i % 2 else w for i, w in enumerate(words))
    formula = "if a<b then " + text + " else c>d"
    assert found(index, [FILLER + marked + FILLER, formula]) == [{item}, {item}]
    kept = [leaks.as_words(p) for p in leaks.folded_parts(["x <!-- a > b --> y", "<!-- want", "p<q r s"])]
    assert kept == [["x", "y"], ["want"], ["p", "q", "r", "s"]]


def test_long_texts_align_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, 40)
    b = np.r_[rng.integers(100, 150, 700), a[:15], [7, 200], a[17:], rng.integers(100, 150, 900), a[5:12]]
    whole = leaks.align(a, b)
    monkeypatch.setattr(leaks, "CELLS", 1)
    assert leaks.align(a, b) == whole and whole[4] >= 35


def test_shards_find_what_one_index_finds(spark, items, index):
    table = spark.createDataFrame(sorted(items.items()), "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"{FILLER} {text} {FILLER}") for i, text in sorted(items.items())[:30]], "doc_id bigint, text string")
    shards = leaks.index_of(table, shard=50)
    assert len(shards) == -(-len(items) // 50)
    assert sorted(map(tuple, leaks.find_leaks(docs, shards).collect())) == sorted(map(tuple, leaks.find_leaks(docs, index).collect()))


def test_blocks_are_skipped(index):
    """A window with a few common terms opens no block; one with a passage opens some."""
    opened = []

    class Spy:
        def __len__(self):
            return len(index.block)

        def __getitem__(self, rows):
            opened.append(len(rows))
            return index.block[rows]

    from dataclasses import replace

    spy = replace(index, block=Spy())
    few = index.terms[np.argsort(index.term_most)[:3]]
    assert len(spy.search(np.zeros(3, np.int64), few)[0]) == 0 and sum(opened) == 0
    spy.search(np.zeros(4000, np.int64), index.terms[:4000])
    assert 0 < sum(opened) <= int(np.diff(index.block_start)[:4000].sum())


def test_other_tokenizers_are_refused(tmp_path):
    import json

    with pytest.raises(ValueError, match="normalizer, pre_tokenizer, model"):
        bpe.Vocabulary.load(f"{TOKENIZERS}/word_bpe_49k.json")
    with open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as f:
        given = json.load(f)
    given["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(given))
    with pytest.raises(ValueError, match="pre_tokenizer"):
        bpe.Vocabulary.load(str(tmp_path / "t.json"))


def test_a_word_of_megabytes(vocabulary, library):
    rng = random.Random(8)
    texts = ["a" * 300_000, "".join(rng.choice("abcdefghij") for _ in range(100_000)), "\u4e00\u5b57" * 50_000]
    ids, counts = vocabulary.encode([t.encode() for t in texts])
    ends = np.cumsum(counts)
    for t, s, e in zip(texts, ends - counts, ends, strict=True):
        assert library.encode(t, add_special_tokens=False).ids == ids[s:e].tolist()

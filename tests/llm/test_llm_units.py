"""The operators' kernels against brute force, without Spark."""

import math
import random
import re

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import bpe, chat, minhash, quality, secrets, spans, toxicity, vectors

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _repeats(words, least):
    covered, longest = set(), 0
    for a in range(len(words)):
        for b in range(a + 1, len(words)):
            n = 0
            while b + n < len(words) and words[a + n] == words[b + n]:
                n += 1
            if n >= least:
                longest = max(longest, n)
                covered |= {*range(a, a + n), *range(b, b + n)}
    return len(covered), longest


def test_quality_measures_match_brute_force():
    rng = random.Random(1)
    for _ in range(80):
        texts = [" ".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 50))) for _ in range(4)]
        m = quality.measure(texts, quality.Rules())
        for k, t in enumerate(texts):
            assert _repeats(t.split(), 5) == (m["n_repeat_words"][k], m["longest_repeat"][k]), t


def test_quality_edges():
    m = quality.measure([None, "", "\x85 a\tb\x0bc", "x\nx\n \nx", "é " * 12], quality.Rules())
    assert m["n_words"].tolist() == [0, 0, 4, 3, 12]  # U+0085 is no space here
    assert m["word_chars"].tolist() == [0, 0, 4, 3, 12]
    assert m["n_dup_lines"].tolist() == [0, 0, 0, 2, 0]
    assert m["base_failed"].tolist() == [True] * 5
    assert not m["kept"].any()


def test_maximal_repeats_are_maximal():
    words = "a b c d e x a b c d e y a b c d e f".split()
    assert quality.maximal_repeats(words, 3) == [(5, (0, 6, 12))]


def test_base_spans_match_plain_regex():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "@", ".", "1", "23", "456", " ", "-", "+", "(", ")", "x.y", "%", "é", "4111111111111111", "255"]) for _ in range(rng.randint(0, 25)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and spans.luhn(digits(m))]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
        assert sorted(spans.personal(t)) == sorted(want), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "+1" + "-" * 200_000, "password" + " " * 200_000, "0123456789abcdef" * 20_000):
        spans.personal(t)
        spans.secrets(t)


def test_luhn():
    assert spans.luhn("4111111111111111") and not spans.luhn("4111111111111112")


def test_guess_bits_prefers_structure():
    ranks = secrets.word_ranks(VOCABULARY)
    dear = min(secrets.guess_bits(v, ranks)[0] for v in ("x9#kQ2!vLp", "7602ad27cf5550de1c"))
    cheap = max(secrets.guess_bits(v, ranks)[0] for v in ("password123", "qwertyuiop", "aaaaaaaaaaaa", "20240131", "P@ssw0rd", "changeme"))
    assert cheap < secrets.MIN_BITS < dear
    assert [k for k, _, _ in secrets.guess_bits("Summer2024!", ranks)[1]] == ["word", "date", "brute"]


def test_guess_bits_is_the_least_over_segmentations():
    ranks = {"ab": 1, "abc": 5, "cd": 2}

    def least(v):
        best = {0: 0.0}
        for j in range(1, len(v) + 1):
            options = [best[j - 1] + secrets._char_bits(v[j - 1])]
            options += [best[i] + 1.5 + math.log2(ranks[v[i:j]] + 1) for i in range(j) if v[i:j] in ranks]
            best[j] = min(options)
        return best[len(v)]

    for v in ("abcd", "abxcd", "xabcab", "cdab"):
        assert secrets.guess_bits(v, ranks)[0] <= least(v) + 1e-9


def test_guess_bits_has_no_bound_on_words_or_periods():
    ranks = {"antidisestablishmentarianism": 3, "ab": 1}
    assert secrets.guess_bits("antidisestablishmentarianism", ranks)[1] == [("word", 0, 28)]
    assert secrets.guess_bits("x9#kq2!vlp" * 3, ranks)[1] == [("repeat", 0, 30)]
    rng = random.Random(8)
    for _ in range(500):
        v = "".join(rng.choice(["ab", "a", "1", "Q", "#", "xyz", "1990", "qwe"]) for _ in range(rng.randint(1, 12)))
        full = secrets.guess_bits(v, ranks)[0]
        for enough in (5.0, 30.0):
            assert secrets.guess_bits(v, ranks, enough)[0] == min(full, enough)


def test_secrets_are_found_beyond_the_patterns():
    ranks = secrets.word_ranks(VOCABULARY)
    t = 'my passphrase is "x9#kQ2!vLp" and password: changeme'
    assert [t[a:b] for _, a, b in secrets.guessed(t, ranks)] == ["x9#kQ2!vLp"]


@pytest.mark.parametrize(
    "text, want",
    [
        ('passphrase: "correct horse battery staple" ok', "correct horse battery staple"),
        ("password: Tr!0ub4,dor&3;xY next", "Tr!0ub4,dor&3;xY"),
        ("password          =          S3cr!t$x9Qz", "S3cr!t$x9Qz"),
        ("password:\tS3cr!t$x9Qz", "S3cr!t$x9Qz"),
        ("{'password': 'S3cr!t $x9Qz', 'user': 'bob'}", "S3cr!t $x9Qz"),
        ('password: "S3cr!t$x9Qz', "S3cr!t$x9Qz"),
        ("login is x9#kQ2!vLp, then", "x9#kQ2!vLp"),
    ],
)
def test_secrets_are_whole_values(text, want):
    assert [text[a:b] for _, a, b in secrets.guessed(text, secrets.word_ranks(VOCABULARY))] == [want]


def test_secret_contexts_take_linear_time():
    ranks = secrets.word_ranks(VOCABULARY)
    for t in ("password" + " " * 200_000, "password:" + "\t" * 200_000, 'password: "' + "\\" * 5000, "pin:" * 5000):
        secrets.guessed(t, ranks)


@pytest.mark.parametrize("seed", range(3))
def test_bpe_equals_the_library(seed):
    rng, library, encoder = random.Random(seed), Tokenizer.from_file(VOCABULARY), bpe._encoder(open(VOCABULARY).read())
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "re", "é", "中", "😀", " ", "　", "\x1c", "\x85", "23", "½", "!!", "----", "<|endoftext|>", "<|end", "ing", "́", "ſ", "\x00"]
    for _ in range(600):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        want = library.encode(s, add_special_tokens=False).ids
        assert encoder.encode(s) == want, s
        got, at = [], 0
        while at < len(s):
            step = rng.randint(1, 4)
            got += encoder.feed(s[at : at + step])
            at += step
        assert got + encoder.finish() == want, s
        assert bpe.Decoder(encoder.m).feed(want, True) == library.decode(want, skip_special_tokens=False)


def test_bpe_streams_long_pieces_in_little_memory():
    library, encoder = Tokenizer.from_file(VOCABULARY), bpe._encoder(open(VOCABULARY).read())
    for s in ("ab" * 4000, " " * 5000 + "x", "-" * 5000 + "'re", "1" * 3000 + "a", " " + "quick" * 1500, "\n" * 3000):
        got, most = [], 0
        for at in range(0, len(s), 1000):
            got += encoder.feed(s[at : at + 1000])
            most = max(most, len(encoder.carry) + (len(encoder.open.data) if encoder.open else 0))
        assert got + encoder.finish() == library.encode(s, add_special_tokens=False).ids
        assert most < 2100


def test_bpe_works_out_short_pieces_together(monkeypatch):
    rng, library, encoder = random.Random(4), Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe._encoder(open(VOCABULARY).read()).m)
    monkeypatch.setattr(bpe.Recent, "SIZE", 300)
    parts = ["tion", "ou", "the", "x", "é", "ß", "中", "😀", "́", "'s", "'", "  ", "\n", "_", "7", "½", "--", "\x00", "\x85", "\u3000", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) + " " * (rng.random() < 0.2) for _ in range(rng.randint(0, 40))) for _ in range(900)]
    texts[5:8] = [texts[4], "", "\n" * 64]
    texts = [t for t in texts if all(len(p) <= 64 for p in bpe.pieces_of(t))]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        encoder.prepare(some)
        with monkeypatch.context() as m:
            m.setattr(bpe.Transducer, "feed", None)  # no piece goes alone
            got = [encoder.encode(t) for t in some if "<|" not in t]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in some if "<|" not in t]
        assert [encoder.encode(t) for t in some] == [library.encode(t, add_special_tokens=False).ids for t in some]
    m = encoder.m
    ids = [rng.choice(list(m.whole.values())) for _ in range(6000)]
    assert m.lockstep.fits(np.array(ids[::2]), np.array(ids[1::2])).tolist() == [m.fits(a, b) for a, b in zip(ids[::2], ids[1::2])]
    assert [b"".join(map(m.bytes_of.get, x)) for x in m.lockstep([b"\xff\x00", b"a" * 300])] == [b"\xff\x00", b"a" * 300] and m.lockstep([]) == []


def test_pieces_are_the_same_with_classes_spelled_out():
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000)]]
    for t in ("".join(f"a{c}1{c}{c} {c}'{c}!" for c in every), "a  b\n\n c's 're x'll'd \t", "😀 a" + "".join(every)):
        assert bpe.pieces_of(t) == bpe._PIECES.findall(t) and "".join(bpe.pieces_of(t)) == t


def test_decoder_replaces_bad_bytes():
    m = bpe._encoder(open(VOCABULARY).read()).m
    d = bpe.Decoder(m)
    first = m.id_of["é".encode()[:1]]
    assert d.feed([first]) + d.feed([m.id_of[b"a"]], True) == "�a"


def test_chat_round_trip_of_hostile_turns():
    rng = random.Random(5)
    parts = ["###", "</turn>", "\\", "\n", " ", "User", ": ", "### Assistant: ", "\n</turn>\n", "x"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "tool", "", "a:b\n\\", "="]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 4))]
        out = chat.format_conversation(turns)
        assert [(r, t) for r, t, _, _ in chat.parse(out)] == turns
        assert [chat.unescape(out[a:b]) for a, b in chat.loss_spans(out)] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("n", range(3, 11))
def test_chat_runs_of_hashes(n):
    h = "#" * n
    for t in (h, f"{h} Heading", f"a\n{h} b\n", "\\" + h, f"\\\\{h}\\", f"{h}</turn>{h}", f"{h}\n</turn>\n{h} User: x"):
        out = chat.format_conversation([("user", t), ("assistant", t)])
        assert [(r, x) for r, x, _, _ in chat.parse(out)] == [("user", t), ("assistant", t)]
        assert len(chat.render_turn("user", t)) == len(t) + len(re.findall("###|</turn>", t)) + 4 + 15


@pytest.mark.parametrize("step", [1, 2, 7, 50])
def test_chat_reads_a_stream_in_pieces(step):
    rng = random.Random(step)
    parts = ["###", "</turn>", "\\", "\n", "#", "### Assistant: ", "\n</turn>\n", "\n</turn>\n### User: x", "é"]
    turns = [(rng.choice(["user", "assistant", "a:b\n"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(200)]
    out = chat.format_conversation(turns)
    reader, got = chat.Reader(), []
    for at in range(0, len(out), step):
        got += reader.feed(out[at : at + step])
        assert len(reader.buf) - reader.pos < 400
    assert got + reader.feed("", True) == chat.parse(out)
    assert [(r, t) for r, t, _, _ in got] == turns
    with pytest.raises(chat.ParseError):
        chat.Reader().feed(out[:-1], True)


def test_chat_plain_text_is_not_escaped():
    assert chat.render_turn("user", "hello \\ there") == "### User: hello \\ there\n</turn>\n"
    with pytest.raises(chat.ParseError):
        list(chat.parse("### User: x"))


def test_toxic_misspellings_share_vectors():
    rng = random.Random(3)
    clean = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "labore", "magna"]
    texts, labels = [], []
    for i in range(300):
        words = [rng.choice(clean) for _ in range(60)]
        if i % 3 == 0:
            words[rng.randrange(60)] = rng.choice(["disgusting", "worthless"])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts, labels)
    scorer = toxicity.Scorer(model)
    base = " ".join(rng.choice(clean) for _ in range(400))
    misspelt, other, clean_score, null, empty = scorer.scores([base + " disgustingg", base + " wortthless", base, None, ""])
    assert min(misspelt, other) > clean_score + 0.2 and null == empty < misspelt
    again = toxicity.train(texts, labels)
    assert np.array_equal(again.table, model.table)


def test_scores_match_a_plain_forward_pass():
    """Each window's mean of its distinct words' mean n-gram vectors through the softmax, word by word."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["good", "bad", "vile!", "words", "x", "--", "Ünï", "words"]) for _ in range(rng.randint(0, 45))) for _ in range(60)]
    model = toxicity.train(texts, [i % 2 for i in range(60)], toxicity.Params(steps=30))
    p = model.params

    def vector(word):
        of, rows = toxicity.gram_rows([word], p)
        return model.table[rows].astype(np.float64).mean(0) if len(rows) else np.zeros(p.size)

    def score(text):
        words = toxicity.tokens(text)
        best = 0.0 if not words else -np.inf
        for at in range(0, max(1, len(words) - p.window // 2), p.window // 2) if words else ():
            bag = sum((vector(w) for w in set(words[at : at + p.window])), np.zeros(p.size)) / p.window
            logits = bag @ model.weight
            best = max(best, logits[1] - logits[0])
        return 1 / (1 + math.exp(-(best + float(model.bias[1] - model.bias[0]))))

    got = toxicity.Scorer(model).scores([*texts, None, ""])
    assert got == pytest.approx([score(t) for t in [*texts, None, ""]], abs=1e-6)


def test_shingles():
    h = minhash._Hashes()
    sizes = [len(minhash.shingle_set(t, h)) for t in (None, "", " \t", "a", "a b", "a b c d e", "a b c d e f", "A B c d e f", "a a a a a a a")]
    assert sizes == [0, 0, 0, 1, 1, 1, 2, 2, 1]
    assert np.array_equal(minhash.shingle_set("A b", h), minhash.shingle_set("a  B\n", h))
    assert not np.array_equal(minhash.shingle_set("b a", h), minhash.shingle_set("a b", h))


def test_tables_reach_the_recall_they_promise():
    h = vectors.Hashing(recall=0.99)
    rng = np.random.default_rng(0)
    a = rng.standard_normal((2000, 32))
    b = rng.standard_normal((2000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9 * a + math.sqrt(1 - 0.81) * b
    bits = 8
    meet = (vectors.signatures(a, bits, h.tables(bits), 1) == vectors.signatures(c, bits, h.tables(bits), 1)).any(1)
    assert meet.mean() >= 0.98

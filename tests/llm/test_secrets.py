import pickle
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tidemark.llm import secrets as S


@pytest.fixture(scope="module")
def model(spark):
    return S.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in S.query(spark, path).collect()}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        want, have = brute.secret_spans(r["text"]), got[r["doc_id"]]
        assert [have["n_assign"], have["n_access"], have["n_hex"]] == [sum(s[0] == k for s in want) for k in S.BASE]
        assert have["base_sha256"] == brute.sha(brute.joined(want))
        assert set(brute.joined(want).split(",")) <= set(have["spans"].split(","))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "PASSWORD", "api_key", "apikey", "ſecret", "secret", "=", ":", " ", '"', "'", "abcdefgh", "A1", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é", "\n", "-", "𝄞"]), max_size=30))
def test_base_spans_equal_plain_patterns(parts):
    text = "".join(parts)
    assert [s[:3] for s in S.base_spans(text)] == brute.secret_spans(text)


def test_formats_are_learned(model):
    drawn = random.Random(99)
    for name, prefixes, alphabet, parts, separator in S.FORMATS:
        made = [drawn.choice(prefixes) + separator.join("".join(drawn.choice(alphabet) for _ in range(k)) for k in parts) for _ in range(40)]
        made = [w for w in made if any(map(str.isdigit, w)) and any(map(str.isalpha, w))]
        assert sum(model.judge(w) == name for w in made) >= 0.9 * len(made), name


def test_ordinary_tokens_are_left_alone(model, spark):
    for word in ("version-2024-11-26-release-notes", "user_profile_settings_2024", "docs/api/v1/reference/index.html", "550e8400-e29b-41d4-a716-446655440000", "1234567890abcdef", "ISBN-978-3-16-148410-0", "thereforehowever2"):
        assert model.judge(word) is None, word


def test_automata_merge_states():
    drawn = random.Random(1)
    words = ["ab-" + "".join(drawn.choice("0123456789") for _ in range(12)) for _ in range(200)]
    automaton = S.Automaton.infer(words)
    seen, pending = {0}, [0]
    while pending:
        for t in automaton.to[pending.pop()].values():
            if t not in seen:
                seen.add(t)
                pending.append(t)
    assert len(seen) < 12
    assert automaton.score("ab-123456789012") > automaton.score("ab-1x3456789012") and automaton.score("ab-123456789012") > automaton.score("xy-123456789012")


def test_a_model_holds_only_states_in_use(model):
    """The tree of the examples has about 100,000 states, and each task gets its own copy of the model."""
    for automaton in [*model.formats.values(), model.background]:
        reached, pending = {0}, [0]
        while pending:
            new = set(automaton.to[pending.pop()].values()) - reached
            reached |= new
            pending += new
        assert reached == set(range(len(automaton.to))) and len(automaton.logs) == len(automaton.counts) == len(automaton.to)
    assert len(pickle.dumps(model)) < 1_000_000


def test_dropped_states_change_no_score(monkeypatch):
    made, fresh = S.made_examples(40), [w for words in S.made_examples(60).values() for w in words[40:]]
    compact = {name: S.Automaton.infer(words) for name, words in made.items()}
    monkeypatch.setattr(S.Automaton, "_compact", lambda self: None)
    for name, words in made.items():
        whole = S.Automaton.infer(words)
        assert len(compact[name].to) < len(whole.to), name
        for w in fresh:
            starts = list(range(0, len(w), 3))
            assert compact[name].score(w) == whole.score(w) and compact[name].suffixes(w, starts) == whole.suffixes(w, starts)


def test_redaction():
    text = 'a token = "abcdef0123456789abcdef0123456789" b'
    spans = S.base_spans(text)
    assert [s[0] for s in spans] == ["assign", "hex"]
    assert S.redact(text, spans) == 'a token = "[SECRET]" b'
    assert S.redact("x", []) == "x"


def test_edges(spark, odd, empty, model):
    rows = S.digests(odd, model).collect()
    assert len(rows) == odd.count() and {r["spans"] for r in rows} == {""}
    assert S.digests(empty, model).count() == 0
    bare = S.train(empty)
    assert bare.background is None and bare.judge("ghp_" + "a1B2c3D4e5F6" * 3) == "github"
    back = S.redacted_rows(odd, model)
    assert back.columns == odd.columns and sorted(r["text"] or "" for r in back.collect()) == sorted(r["text"] or "" for r in odd.collect())
    df = spark.createDataFrame([(1, "secret: 'abcdefghij' é", 22)], "doc_id long, text string, n_chars long")
    assert tuple(S.redacted_rows(df, model).first()) == (1, "secret: '[SECRET]' é", 20)
    found = S.find(df, model).first()
    assert [tuple(s) for s in found["base"]] == [("assign", 0, 19)] and found["redacted"] == "secret: '[SECRET]' é"


def test_credentials_inside_of_longer_runs(model):
    drawn = random.Random(4)
    body = lambda n, of=S.ALNUM: "".join(drawn.choice(of) for _ in range(n - 1)) + "7"
    secrets = {"github": f"ghp_{body(36)}", "gitlab": f"glpat-{body(20)}", "stripe": f"sk_live_{body(24)}", "google": f"AIza{body(35)}", "npm": f"npm_{body(36)}", "slack": f"xoxb-{body(12, '0123456789')}-{body(12, '0123456789')}"}
    for name, secret in secrets.items():
        for before, after in (("GH_PAT=", ""), ("see --pat=", " now"), ("https://host/?key=", "&x=1"), ("https://host/v1/", "/info"), ("CI_JOB.", "."), ("a/b=", "=")):
            text = f"x {before}{secret}{after}"
            base, added = S.scan(text, model)
            assert not base and (f"fmt_{name}", secret) in [(k, text[a:b]) for k, a, b, _ in added], text
            assert secret not in S.redact(text, base + added)


def test_parts_score_like_words(model):
    word = "ab=ghp_12/x-eyJ0.Zz_9" * 3
    for automaton in model.formats.values():
        starts = list(range(0, len(word), 5))
        assert automaton.suffixes(word, starts) == pytest.approx([automaton.score(word[s:]) for s in starts])


def test_long_runs_take_time_in_proportion(model):
    import time

    began = time.process_time()
    for run in ("eyJ" * 20_000 + "1", "a1-" * 20_000, "a1/b=" * 12_000, "ghp_1" * 12_000):
        S.scan(run, model)
    assert time.process_time() - began < 60


def test_web_tokens_of_any_length(model):
    standard = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIiwiaWF0IjoxNTE2MjM5MDIyfQ.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"
    assert len(standard) == 155 and model.judge(standard) == "jwt"
    drawn = random.Random(8)
    for sizes in ((17, 20, 43), (33, 60, 43), (40, 150, 86), (33, 300, 342)):
        words = ["eyJ" + ".".join("".join(drawn.choice(S.ALNUM + "_-") for _ in range(k)) for k in sizes) for _ in range(20)]
        assert sum(model.judge(w) == "jwt" for w in words) >= 18, sizes


def plain_added(text, model):
    """Every candidate of a text scored on its own, and the best kept: no shared suffixes, no run without a digit left out beforehand."""
    import re

    base, added = S.base_spans(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]{16,}", text):
        run, at = m[0], m.start()
        taken = [(a, b) for _, a, b, _ in base]

        def told(a, b, names, run=run):
            word = run[a:b]
            if len(word) < 16 or not any(map(str.isdigit, word)) or not any(map(str.isalpha, word)):
                return None
            score, name = max((model.formats[n].score(word), n) for n in names if n in model.formats and len(word) >= model.shortest[n])
            plain = model.background.score(word)
            return ((score - plain) * (len(word) + 1), a, b, name) if score >= model.floor[name] and score - plain >= S.RATIO else None

        begins = [i for i in range(1, len(run)) if run[i - 1] in "=/._-" and run[i] not in "=/._-"]
        end = len(run.rstrip(".=-"))
        others = [(i, end, model.formats) for i in begins]
        for piece in re.finditer("[^=/]+", run):
            if piece.end() < len(run):
                stop = piece.start() + len(piece[0].rstrip(".=-"))
                others += [(i, stop, model.formats) for i in sorted({piece.start(), *(b for b in begins if piece.start() < b < piece.end())})]
        own = []
        for name, prefixes, alphabet, _, separator in S.FORMATS:
            inside = 0
            while (starts := [run.find(p, inside) for p in prefixes if run.find(p, inside) >= 0]) :
                a = min(starts)
                b = a + len(next(p for p in prefixes if run.startswith(p, a)))
                while b < len(run) and run[b] in alphabet + separator:
                    b += 1
                stop = a + len(run[a:b].rstrip(".=-"))
                own += [(i, stop, [name]) for i in range(a, b) if any(run.startswith(p, i) and i + len(p) <= b for p in prefixes)]
                inside = b
        best = lambda found: sorted((x for x in (told(*f) for f in found) if x), key=lambda x: (-x[0], x[1], x[2] - x[1], x[3]))
        whole = []
        word = run.rstrip(".=-")
        if len(word) >= 16 and word[0] != "." and (x := told(0, len(word), model.formats)) and not any(a < at + len(word) and at < b for a, b in taken):
            whole = [x]
        for _, a, b, name in best(own) + whole + best(others):
            if not any(x < at + b and at + a < y for x, y in taken):
                taken.append((at + a, at + b))
                added.append((f"fmt_{name}", at + a, at + b))
    return sorted(added, key=lambda s: s[1])


def planted_secrets(drawn):
    """(text, secret) of every format, in several surroundings."""
    for name, words in S.made_examples(6).items():
        for word in words:
            for around in ("see {} now", "GH_PAT={}", "https://host/?key={}&x=1", "x/{}/info", "a.{}."):
                yield around.format(word), word


def test_every_candidate_is_scored(model, spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += [t for t, _ in planted_secrets(random.Random(2))] + ["v1/docs/api-2024.11.26_release=notes/index2.html and user_profile_settings_2024"]
    found = 0
    for text in texts:
        added = [x[:3] for x in S.scan(text, model)[1]]
        assert added == plain_added(text, model), text[:200]
        found += len(added)
    assert found >= 0.95 * 9 * 6 * 5  # nine formats beside the base patterns


def test_clean_documents_stay_clean(model, spark):
    added = [text[a:b] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect() if (text := r["text"]) for _, a, b, _ in S.scan(text, model)[1]]
    assert added == []


def test_more_published_formats(model):
    drawn = random.Random(12)
    body = lambda n, of=S.ALNUM: "".join(drawn.choice(of) for _ in range(n - 1)) + "7"
    for name, secret in {"githubpat": f"github_pat_{body(22)}_{body(59)}", "sendgrid": f"SG.{body(22)}.{body(43)}"}.items():
        for text in (f"a {secret} b", f"KEY={secret}"):
            assert (f"fmt_{name}", secret) in [(k, text[a:b]) for k, a, b, _ in S.scan(text, model)[1]], text


def test_the_sample_has_no_prefixes(spark):
    long = "ab0" * 100
    df = spark.createDataFrame([(f"password={long} token={'q7' * 10}{'abcdefghij'[i % 10]}{i:03}",) for i in range(60)], "text string")
    examples = S.train(df).examples["assign"]
    assert len(examples) == 60 and not any(long.startswith(w) for w in examples)
    assert len(S.train(df, bound=30).examples["assign"]) == 30

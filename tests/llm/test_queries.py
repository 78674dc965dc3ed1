"""Every registered query, and every stage of the pipeline, on the small tables against
plain Python that shares no code with the operators but the tokenizer."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from urlrisk.llm import registry
from urlrisk.llm.language import BUCKETS
from urlrisk.llm.pii import find_spans
from urlrisk.llm.quality import features

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the generated tables")


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return rows("documents")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(registry.tokenizer_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def components(nodes, linked):
    """The smallest member of the component of each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def first_fit_count(lengths, room=2048):
    """How many sequences best-fit decreasing takes."""
    left = []
    for x in sorted(lengths, reverse=True):
        fit = min((k for k in range(len(left)) if left[k] >= x), key=lambda k: left[k], default=None)
        if fit is None:
            left.append(room - x)
        else:
            left[fit] -= x
    return len(left)


def check_packing(found, texts, library):
    pieces, slots = {}, defaultdict(list)
    for d, t in texts.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            pieces[d, k // 2048] = (k, len(ids[k : k + 2048]), crc(ids[k : k + 2048]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == pieces and len(found) == len(pieces)
    for r in found:
        slots[r.sequence_id].append((r.offset, r.length))
    for own in slots.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(slots) == first_fit_count([n for _, n, _ in pieces.values()])


def test_op1(spark, docs, library):
    check_packing(registry.op1_packing(spark, SF).collect(), {d["doc_id"]: d["text"] for d in docs}, library)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_op2(spark, docs):
    prints = {d["doc_id"]: fingerprint(d["text"]) for d in docs}
    roots = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = registry.op2_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{p:016x}", roots[d]) for d, p in prints.items()}


def test_op4(spark, docs, library):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in registry.op4_token_files(spark, SF).collect()}
    at, want = 0, {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        want[d["doc_id"]] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def base(text):
    """The base spans, by the patterns of the contract."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def test_op6(spark, docs):
    got = {r.doc_id: r for r in registry.op6_pii(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        own = base(d["text"] or "")
        r = got[d["doc_id"]]
        text = ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in own)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        counts = Counter(kind for *_, kind in own)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_op7_has_every_conversation(spark):
    found = registry.op7_chat(spark, SF).collect()
    turns = rows("conversations")
    assert {r.conv_id for r in found} == {t["conv_id"] for t in turns}
    assert sum(r.n_lines for r in found) == sum((t["text"] or "").count("\n") + 1 for t in turns)


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def contaminated(texts):
    """(document, item, shared, all) by looking every shingle up in every document."""
    out = []
    for item in rows("benchmark"):
        own = shingles(item["text"])
        for d, t in texts.items():
            words = re.findall(r"\w+", (t or "").lower())
            n = len(next(iter(own))) if own else 0
            held = own & {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            if own and len(held) >= 0.8 * len(own) - 1e-9:
                out.append((d, item["item_id"], len(held), len(own)))
    return out


def test_op8(spark, docs):
    got = [(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in registry.op8_decontamination(spark, SF).collect()]
    want = contaminated({d["doc_id"]: d["text"] for d in docs})
    assert sorted(got) == sorted(want) and len(want) > 0


def quality_scores(docs, held=True):
    """Two shrunk Gaussians from the whole matrix, by their densities."""
    labels = {r["doc_id"]: r["quality"] for r in rows("labels")}
    x = {d["doc_id"]: np.array(features(d["text"])) for d in docs}
    fit = [i for i in x if labels.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    logs, covs, sets = [], [], [np.array([x[i] for i in fit if labels[i] == c]) for c in (0, 1)]
    own = [np.cov(s.T, bias=True) for s in sets]
    pooled = sum(len(s) * c for s, c in zip(sets, own, strict=True)) / len(fit)
    for s, c in zip(sets, own, strict=True):
        cov = 0.9 * (0.8 * c + 0.2 * pooled) + 0.1 * np.diag(np.maximum(np.diag(pooled), 1e-6)) + 1e-9 * np.eye(len(c))
        covs.append(cov)
        inverse, (_, det) = np.linalg.inv(cov), np.linalg.slogdet(cov)
        logs.append({i: math.log(len(s) / len(fit)) - 0.5 * det - 0.5 * (v - s.mean(axis=0)) @ inverse @ (v - s.mean(axis=0)) for i, v in x.items()})
    return {i: 1 / (1 + math.exp(min(700, logs[0][i] - logs[1][i]))) for i in x}


def test_op9(spark, docs):
    want = quality_scores(docs)
    got = {r.doc_id: r for r in registry.op9_quality(spark, SF).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert abs(r.score - want[i]) < 1e-6 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def grams(text):
    """The buckets of a text's n-grams, one at a time."""
    chars = [c if ord(c) > 127 or c.isascii() and c.isalpha() else " " for c in f" {(text or '').lower()} "]
    out = []
    for n in (1, 2, 3):
        for k in range(len(chars) - n + 1):
            g = chars[k : k + n]
            if any(c != " " for c in g):
                h = n
                for c in g:
                    h = ((h ^ ord(c)) * 0x9E3779B1) % 2**32
                    h ^= h >> 15
                out.append(h % BUCKETS)
    return out


def test_op10(spark, docs):
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2 for d in docs}
    found = {d["doc_id"]: Counter(grams(d["text"])) for d in docs}
    counts = defaultdict(Counter)
    for d in docs:
        if d["lang"] is not None and not held[d["doc_id"]]:
            counts[d["lang"]].update(found[d["doc_id"]])
    total = {a: sum(c.values()) + 0.5 * BUCKETS for a, c in counts.items()}
    got = {r.doc_id: r for r in registry.op10_language(spark, SF).collect()}
    right = []
    for d in docs:
        r = got[d["doc_id"]]
        assert r.held_out == held[d["doc_id"]] and 0 <= r.score <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r.lang_pred == "und"
            continue
        logs = {a: sum(n * math.log((c[b] + 0.5) / total[a]) for b, n in found[d["doc_id"]].items()) for a, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        assert r.lang_pred == best
        assert abs(r.score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-2
        if r.held_out and d["lang"]:
            right.append(r.lang_pred == d["lang"])
    assert np.mean(right) > 0.95


def five_words(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 5 else {tuple(words)} if words else set()


def test_pipeline_stage_by_stage(spark, docs, library):
    """Each stage on what the one before kept, as the pipeline's own run gives it."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "private", "packing"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns = table.columns

    def step(name, before):
        after = corpus_pipeline.materialize(dict(corpus_pipeline.STAGES)[name](spark, before, SF), name)
        found = after.collect()
        return after, found

    after, found = step("quality", table)
    score = quality_scores(docs)
    assert after.columns == columns and sorted(r.doc_id for r in found) == sorted(i for i, s in score.items() if s >= 0.3)
    texts = {d["doc_id"]: d["text"] for d in docs}
    assert all(r.text == texts[r.doc_id] for r in found)

    sets = {r.doc_id: five_words(r.text) for r in found}
    roots = components(list(sets), lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    after, found = step("near_duplicates", after)
    assert after.columns == columns and sorted(r.doc_id for r in found) == sorted(set(roots.values()))

    bad = {d for d, *_ in contaminated({r.doc_id: r.text for r in found})}
    left = sorted(r.doc_id for r in found if r.doc_id not in bad)
    after, found = step("decontaminate", after)
    assert after.columns == columns and sorted(r.doc_id for r in found) == left

    before = {r.doc_id: r.text for r in found}
    after, found = step("private", after)
    assert after.columns == columns and sorted(r.doc_id for r in found) == left
    for r in found:
        assert not base(r.text) and r.n_chars == len(r.text)
        at = 0
        for part in re.split(r"\[(?:EMAIL|IP|CARD|PHONE|URL|ACCOUNT|SECRET)\]", r.text):  # what is between is the text as it was
            at = before[r.doc_id].index(part, at) + len(part)
        if not find_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id]

    _, packed = step("packing", after)
    check_packing(packed, {r.doc_id: r.text for r in found}, library)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, packed))

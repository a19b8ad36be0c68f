import hashlib
from collections import Counter

import numpy as np

from tagwise.llm import alignment
from tagwise.llm.common import Remembered
from tagwise.llm.queries import QUERIES, tokenizer_path
from tests.llm.fixtures import awkward_rows, clashing, documents

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
ODD = ["a  b   c\n\n d \n e", " lead", "trail ", "   ", " ", "\n", " \n ", "it's  they'll <|endoftext|> <s> <unk> <0x41> done",
       "tab\t x \x85 y\xa0 z", "\x1c \x1d a \x1e b", "naïve ﬁ café 漢字 🙂🙂 é", "▁ x", "a▁b", "0x41 aaaa aaaaaaaa", "x\x00y"]


def brute(rows):
    """Whole texts, all pairs of overlapping occurrences, counts over everything."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment._byte_letters()
    names = {i: t for t, i in a.get_vocab().items()}

    def spans(parts):
        ends = np.cumsum([0, *map(len, parts)]).tolist()
        return list(zip(ends, ends[1:]))

    found, counts = [], Counter()
    for d, t, *_ in rows:
        whole = (" " + (t or "")).encode()
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        wa = [bytes(letters[c] for c in names[i]) for i in ia]
        wb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ib)]
        if not t or b"".join(wa) != whole or b"".join(wb) != whole:
            found.append((d, [], [], [], ""))
            continue
        sa, sb = spans(wa), spans(wb)
        links, at = [], 0
        for i, (x, y) in enumerate(sa):
            while sb[at][1] <= x:
                at += 1
            j = at
            while j < len(sb) and sb[j][0] < y:
                links.append((ia[i], ib[j]))
                j += 1
        cuts = sorted({y for _, y in sa} & {y for _, y in sb})
        text, i, j = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(sa) and sa[i][1] <= c:
                ga.append(ia[i])
                i += 1
            while j < len(sb) and sb[j][1] <= c:
                gb.append(ib[j])
                j += 1
            text.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        found.append((d, ia, ib, links, ";".join(text)))
        counts.update(links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(d, len(ia), len(ib), text.count(";") + 1 if text else 0, len(links), sum(counts[p] == best[p[1]] for p in links),
             sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "") for d, ia, ib, links, text in found], \
        {(x, y, n, n == best[y]) for (x, y), n in counts.items()}


def rows_of():
    rows = [r for r in awkward_rows() if not r[1] or len(r[1]) < 50_000]
    return rows + [(400 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_counts_and_groups_equal_brute_force(spark):
    rows = rows_of()
    docs, pairs = brute(rows)
    got = alignment.align(clashing(documents(spark, rows)).repartition(5), A, B)
    assert got.documents.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(got.documents.collect()) == ordered(docs)
    assert {tuple(r) for r in got.pairs.collect()} == pairs


def test_small_blocks_give_the_same(spark, monkeypatch):
    """Blocks closed after every few links (the tasks get the patched value) change nothing."""
    rows = rows_of()[:30]
    docs = documents(spark, rows).coalesce(1)
    want = ordered(alignment.align(docs, A, B).documents.collect())
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 50)
    blocks = alignment._first_pass(docs, A, B, "text", "doc_id").where("kind = 2").select("block").distinct()
    assert ordered(alignment.align(docs, A, B).documents.collect()) == want == ordered(brute(rows)[0])
    assert blocks.count() > 20


def test_long_text_without_spaces():
    both = alignment.pair(A, B)
    groups, codes, n_a, n_b = both.align(["x" * 3000 + " tail"])[0]
    assert len(codes) >= max(n_a, n_b) and groups.count(";") + 1 <= n_a
    assert all(len(c) <= alignment.LONG_CHUNK for c in both.chunks.known)


def test_links_survive_their_planes():
    where, times = np.array([0, 3, 70_000, 70_001]), np.array([1, 300, 1, 70_000])
    assert [x.tolist() for x in alignment._from_planes(alignment._planes(where, times))] == [where.tolist(), times.tolist()]


def test_groups_as_rows(spark):
    rows = {r[0]: r[1] for r in alignment.groups(documents(spark, [(1, "ab cd", "", "", 0), (2, None, "", "", 0)]), A, B).collect()}
    assert rows[2] is None and sum(len(g.a) for g in rows[1]) >= 2 and len(rows[1]) >= 2


def test_query_and_empty_table(spark, tmp_path):
    assert alignment.align(documents(spark, []), A, B).documents.collect() == []
    rows = [(1, "one two", "en", "s", 0), (2, "one two", "en", "s", 0), (2, None, "en", "s", 0)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert ordered(QUERIES["op11_token_alignment"](spark, str(tmp_path)).collect()) == ordered(brute(rows)[0])


def test_remembered_drops_what_is_not_asked_for_again():
    kept = Remembered(100)
    for k in range(40):
        found, new = kept.look_up([k, 0, k])
        assert new == [x for x in dict.fromkeys([k, 0]) if x not in kept.known] and list(found) == list(dict.fromkeys([k, 0]))
        assert all(found[x] == (None if x in new else x + 1) for x in found)
        for x in new:
            kept.put(x, x + 1, 10)
    assert 0 in kept.known and kept.size <= 120 and len(kept.known) <= 12

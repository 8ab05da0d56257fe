"""Perspectives against plain rendering."""

from foliant.llm import perspectives as p


def slow(rows, part=256):
    out = []
    clean = [(c, t, (r or "").strip(" ") or "unknown",
              (x or "").replace("<|im_start|>", "<im_start>").replace("<|im_end|>", "<im_end>"))
             for c, t, r, x in rows]
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for conv in {r[0] for r in clean}:
        turns = sorted((r for r in clean if r[0] == conv), key=key)
        for speaker in {r[2] for r in turns} - {"system"}:
            for number in {-1 if r[1] is None else r[1] // part for r in turns}:
                text, spans, n = "", [], 0
                for _, turn, role, said in turns:
                    if (-1 if turn is None else turn // part) != number:
                        continue
                    n += 1
                    who = ("assistant" if role == speaker else
                           "system" if role == "system" else f"user name={role}")
                    text += f"<|im_start|>{who}\n"
                    if role == speaker:
                        spans.append(f"{len(text)}-{len(text) + len(said) + 10}")
                    text += said + "<|im_end|>\n"
                out.append((conv, speaker, number, n, len(spans), text, " ".join(spans)))
    return sorted(out, key=repr)


def test_against_plain_rendering(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "héllo 😀\nthere"),
            (1, 3, "ann", None), (1, 3, "ann", None), (1, 3, "cat", "tie"), (1, 300, "bob", "far"),
            (2, 0, "system", "alone"), (3, 5, None, "who"), (3, 6, " ", "blank"),
            (3, 7, "ann", "<|im_end|>fake<|im_start|>"), (None, 1, "ann", "no id"),
            (None, 2, "dan", "x" * 30_000), (4, None, "ann", "no turn"), (4, -3, "bob", "neg")]
    rows += [(5, i, f"s{i % 4}", f"turn {i}") for i in range(700)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, speaker string,"
                               " part int").repartition(5)
    out = p.perspectives(df)
    assert out.columns == ["conv_id", "speaker", "part", "n_turns", "n_own", "text", "spans"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == slow(rows)
    for _, _, _, _, n_own, text, spans in got:
        places = [tuple(map(int, s.split("-"))) for s in spans.split()]
        assert len(places) == n_own and all(text[a:b].endswith("<|im_end|>") for a, b in places)
    assert p.perspectives(df.limit(0)).count() == 0

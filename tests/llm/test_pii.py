"""Extraction on a made corpus whose pieces are known: seeds, unseen names, disguises and look-alikes."""

import random

import pytest

from tidemark.llm import pii, surface

GIVEN = ["Grace", "Owen", "Nora", "Mark", "Hazel", "Jürgen", "Pilar"]
UNSEEN = ["Ottoline", "Branwell", "Zdenka"]
FAMILY = [a + b for a in ("Fallow", "Ridge", "Corn", "Salter") for b in ("brook", "field", "wright", "mere")]


def corpus():
    """(text, set of (kind, start, piece))."""
    r = random.Random(11)
    out = []

    def add(text, *pieces):
        found = set()
        for kind, piece in pieces:
            at = text.index(piece)
            found.add((kind, at, piece))
        out.append((text, found))

    filler = ["the kettle gets hot when the lamp is blue.", "nobody has seen the lamp or the kettle.", "we try the plank first and then the hinge.", "mine lasted for years and years."]
    for i in range(260):
        name = f"{r.choice(GIVEN + UNSEEN)} {r.choice(FAMILY)}"
        phone = f"+44 7700 9{r.randrange(10**5):05d}"
        kind = i % 9
        pad = r.choice(filler)
        if kind == 0:
            add(f"My name is {name} and I am new here. {pad}", ("name", name))
        elif kind == 1:
            add(f"{pad} Ask for {name}, tel {phone}", ("name", name), ("phone", phone))
        elif kind == 2:
            add(f"{pad}\n\n--\n{name}\n{phone}", ("name", name), ("phone", phone))
        elif kind == 3:
            bare = f"9{r.randrange(10**8):08d}"
            number = f"9{r.randrange(100):02d}-{r.randrange(100):02d}-{r.randrange(10**4):04d}" if i % 2 else bare
            add(f"They asked for my SSN, {number}, can you believe it. {pad}", ("id", number))
        elif kind == 4:
            add(f"Order {r.randrange(10**9, 10**10)} arrived. See ticket #{r.randrange(10**9)} of 2027-01-02. {pad}")
        elif kind == 5:
            street = f"{r.randrange(1, 999)} Old Mill {r.choice(['Road', 'Lane'])}"
            add(f"Ship to {street}, please. {pad}", ("address", street))
        elif kind == 6:
            add(f"The Hazel Grove model from 2012 is what the Mark Ten people told us. {pad}")
        elif kind == 7:
            add(f"Ask {r.choice(GIVEN)} from the club. {pad}")
        else:
            mail = f"{r.choice(FAMILY).lower()}{i}@example.org"
            add(f"Mail me: {mail} {pad}", ("email", mail))
    add("> My name is Grace\n> Fallowbrook and I am new here.", ("name", "Grace\n> Fallowbrook"))
    add("NORA RIDGEFIELD wrote:", ("name", "NORA RIDGEFIELD"))
    add("cc grace cornwright", ("name", "grace cornwright"))
    add("My name is Saltermere, Owen and I am new here.", ("name", "Saltermere, Owen"))
    add("Ask for O. Cornfield, tel ０７７００ ９００１２３", ("name", "O. Cornfield"), ("phone", "０７７００ ９００１２３"))
    add("write to a.b [at] mail [dot] example or c&#64;d.example", ("email", "a.b [at] mail [dot] example"), ("email", "c&#64;d.example"))
    add("see logo@2x.png, put user @ 57 : Put")
    add("")
    add("x" * 300_000)
    return out


@pytest.fixture(scope="module")
def found(spark):
    docs = corpus()
    rows = [(i, t, "k", 1) for i, (t, _) in enumerate(docs)] + [(0, docs[0][0], "k", 1), (9999, None, "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, row int")
    names = spark.createDataFrame([(g,) for g in GIVEN] + [(None,)], "given_name string")
    return docs, df, pii.find_personal_information(df, names)


def test_pieces(found):
    docs, _, f = found
    got = {}
    for r in f.collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.start_at, docs[r.doc_id][0][r.start_at : r.end_at]))
    want = {(i, *p) for i, (_, ps) in enumerate(docs) for p in ps}
    have = {(i, *p) for i, ps in got.items() for p in ps}
    assert len(want & have) / len(want) > 0.97, sorted(want - have)[:8]
    assert len(want & have) / len(have) > 0.97, sorted(have - want)[:8]


def test_redaction_changes_nothing_else(found):
    docs, df, f = found
    got = {r.doc_id: r for r in pii.redact(df, f).collect()}
    assert got[9999].text is None and got[0].kind == "k" and got[0].row == 1
    assert got[0].text.startswith("My name is [NAME] and I am new here.")
    pieces = {}
    for r in f.collect():
        pieces.setdefault(r.doc_id, []).append((r.start_at, r.end_at, r.kind))
    for i, (text, _) in enumerate(docs):
        for a, b, kind in sorted(pieces.get(i, []), reverse=True):
            text = text[:a] + pii.PLACEHOLDERS[kind] + text[b:]
        assert got[i].text == text


def test_no_documents_and_no_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    names = spark.createDataFrame([], "given_name string")
    assert pii.find_personal_information(empty, names).count() == 0
    one = spark.createDataFrame([(1, "mail a@b.example")], "doc_id long, text string")
    assert [(r.kind, r.start_at) for r in pii.find_personal_information(one, names).collect()] == [("email", 5)]


def test_readable_keeps_offsets():
    text = "a<b>b</b>&amp;c\r\n> > d  é ０x​y &bogus; <br/>\n| z"
    norm, at = surface.readable(text)
    assert norm == "ab&c\nd é 0xy &bogus; \nz" and at[len(norm)] == len(text)
    for i, c in enumerate(norm):
        assert c in "\n &0é" or text[at[i]] == c


def test_long_tags_are_no_words(spark):
    tag = f"<span title='{'Quorra Vantage ' * 100}'>"
    norm, at = surface.readable(f"a{tag}b<{'x' * 1000}")
    assert norm.startswith("ab<") and at[1] == 1 + len(tag)
    words = pii.word_counts(spark.createDataFrame([(f"a word {tag} {'y' * 60} {tag}",)], "text string"))
    assert {r.word for r in words.collect()} == {"word", "y" * 60}


def test_contexts_are_whole_words():
    long = "z" * 500
    found = {c[0]: c for c in surface.candidates(f"call {long} now 0123 456 7890", set())}
    assert found["number"][6] == f"call {long} now"


def test_shapes_need_good_company(spark):
    """A shape of telephone numbers that mostly stands where other numbers are none is no telephone number."""
    rows = [("phone", "999 999 9999", "tel is now")] * 30 + [("phone", "+99 999", "tel is now")] * 5 + [("phone", "9/9", "order no of")] * 3 + [("open", "99999999", "order no of")] * 300
    df = spark.createDataFrame([(i, i, "number", 0, 5, *r) for i, r in enumerate(rows)], "row long, doc_id long, kind string, start_at int, end_at int, form string, first string, left string")
    got = {(r.first, r.kind, r.way) for r in pii.decide_numbers(df).collect()}
    assert got == {("999 999 9999", "phone", "seed"), ("+99 999", "phone", "seed")}


def test_addresses_by_street_and_context(spark):
    rows = [("en", "mill", "live at", 1)] * 9 + [("en", "mill", "x y", 0), ("en", "new", "live at", 0)] + [("en", "down main", "i walked", 0)] * 20 + [("en", "mill", "i walked", 1), ("fr", "des", "live at", 0)]
    df = spark.createDataFrame([(i, i, "address", 0, 5, *r) for i, r in enumerate(rows)], "row long, doc_id long, kind string, start_at int, end_at int, form string, first string, left string, flag int")
    got = {(r.first, r.left, r.way) for r in pii.decide_addresses(df).collect()}
    assert got == {("mill", "live at", "seed"), ("mill", "x y", "street"), ("new", "live at", "pattern")}


def test_names_are_found_without_their_seeds(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")
    r = pii.held_out(df, spark.createDataFrame([(g,) for g in GIVEN], "given_name string")).first()
    assert r.n_withheld > 20 and r.n_found_again >= 0.9 * r.n_withheld

import pytest

from threadmill.llm.pii import Finder, mask, mask_personal, mentions

FOUND = [
    ("Write to ann.lee+x@mail.example.org today", "email", "ann.lee+x@mail.example.org"),
    ("use jo [at] post [dot] example, thanks", "email", "jo [at] post [dot] example"),
    ("use jo dot lee at uni dot test please", "email", "jo dot lee at uni dot test"),
    ("see <mailto:x-1@a.test>", "email", "x-1@a.test"),
    ("write to me at t.nab @ uni.test.", "email", "t.nab @ uni.test"),
    ("call +44 7700 900 043 now", "phone", "+44 7700 900 043"),
    ("or (361) 555-0114 ext. 9!", "phone", "(361) 555-0114 ext. 9"),
    ("ring 020 7946 0563.", "phone", "020 7946 0563"),
    ("Tel. 01 99 00 29 73", "phone", "01 99 00 29 73"),
    ("text six oh five five five oh one six one ok", "phone", "six oh five five five oh one six one"),
    ("my SSN, 971228822, over chat", "id_number", "971228822"),
    ("it lists 998-37-1108 as mine", "id_number", "998-37-1108"),
    ("insurance no. QQ 98 90 94 C", "id_number", "QQ 98 90 94 C"),
    ("Passport no. K47697181 got rejected", "id_number", "K47697181"),
    ("my licence (D088-3027-7425)", "id_number", "D088-3027-7425"),
    ("Steuer-ID 43 569 888 629", "id_number", "43 569 888 629"),
    ("I live at 266 W Chandler St, Apt 17 now", "address", "266 W Chandler St, Apt 17"),
    ("in front of 397 orchard drive", "address", "397 orchard drive"),
    ("Ich wohne Gerberweg 472!", "address", "Gerberweg 472"),
    ("adresse : 134, rue du Vieux Moulin", "address", "134, rue du Vieux Moulin"),
    ("Vivo en calle Tenería n.º 55 hoy", "address", "calle Tenería n.º 55"),
    ("it was Maria J. Lopez-Kern who", "name", "Maria J. Lopez-Kern"),
    ("SIGNED, MARIA LOPEZ.", "name", "MARIA LOPEZ"),
    ("talked to Lopez, Maria about", "name", "Lopez, Maria"),
    ("ask Mrs. Hartwell first", "name", "Mrs. Hartwell"),
    ("then L. Kessert came", "name", "L. Kessert"),
]
NOT_FOUND = [
    "I got 7 @ 2.50 each", "@trowel85 posted it", "meet at example.com tomorrow", "seed is 221433118", "Lot XQ 7687016 is sold",
    "Build 5.11.2661", "Order 1410-775-46", "It ran 86 887 994 steps", "From 2024-04-18 to 2024-12-01", "The stop on 15th Street",
    "The Mill Street Band plays", "Maria told me the same", "Both Maria and Emil agree", "thanks to u/Maria_869", "page 680, lines 48-78",
    "We finished 732-693", "you d@mbass", "",
]


@pytest.mark.parametrize("text,kind,mention", FOUND)
def test_found(text, kind, mention):
    assert [(text[a:b], k) for a, b, k in Finder()(text)] == [(mention, kind)]


@pytest.mark.parametrize("text", NOT_FOUND)
def test_not_found(text):
    assert Finder()(text) == []


def test_rest_of_text_is_kept():
    text = "Hi, Maria Lopez (maria@a.test) lives at 12 Elm Road; call 310-555-0129."
    got = mask(text, Finder()(text))
    assert got == "Hi, [NAME] ([EMAIL]) lives at [ADDRESS]; call [PHONE]."


def test_rows(spark):
    long = "plain words " * 50_000 + "me@a.test"
    rows = [(1, "me@a.test me@a.test", None), (2, None, ""), (3, long, "x"), (1, "no", "Maria Lopez"), (None, "a@b.test", None)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "sample_id long, body string, parent_body string, kinds0 string")
    masked = mask_personal(df)
    got = sorted((r.id or 0, r.field, r.kind, r.n) for r in mentions(masked).collect())
    assert got == [(0, "body", "email", 1), (1, "body", "email", 2), (1, "parent_body", "name", 1), (3, "body", "email", 1)]
    by = {(r.id, r.body is None): r for r in masked.collect()}
    assert by[(2, True)].parent_body == "" and by[(2, True)].body_kinds == []
    assert mask_personal(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "text,kind,mention",
    [
        ("text two one two, three four six, one two nine eight ok", "phone", "two one two, three four six, one two nine eight"),
        ("ring Six-One-Seven, four four two, nine eight one one.", "phone", "Six-One-Seven, four four two, nine eight one one"),
        ("mine is AB 12 34 56 C by the way", "id_number", "AB 12 34 56 C"),
        ("mine is jk123456d by the way", "id_number", "jk123456d"),
    ],
)
def test_any_digits_and_prefixes(text, kind, mention):
    assert [(text[a:b], k) for a, b, k in Finder()(text)] == [(mention, kind)]


@pytest.mark.parametrize("text", ["part DA 12 34 56 C", "part GB 12 34 56 C", "part AO123456C", "at 10 20 30 a day", "one or two, three at most, someone alone on the phone"])
def test_no_digits_and_prefixes(text):
    assert Finder()(text) == []


@pytest.mark.parametrize(
    "text,masked",
    [
        ("passport numbers A1234567 and B7654321 expired", "passport numbers [ID_NUMBER] and [ID_NUMBER] expired"),
        ("tax ids 12 345 678 901 and 98 765 432 109.", "tax ids [ID_NUMBER] and [ID_NUMBER]."),
        ("SSN: 971228822, 971228823 / 971228824, and 998-37-1108", "SSN: [ID_NUMBER], [ID_NUMBER] / [ID_NUMBER], and [ID_NUMBER]"),
        ("passport:\n- A1234567\n- B7654321\n- C7654322\nthanks", "passport:\n- [ID_NUMBER]\n- [ID_NUMBER]\n- [ID_NUMBER]\nthanks"),
        ("K1234567, K1234568 or (K1234569) is my passport", "[ID_NUMBER], [ID_NUMBER] or ([ID_NUMBER]) is my passport"),
        ("Reisepass Nr. C1234567 und Nr. C1234568", "Reisepass Nr. [ID_NUMBER] und Nr. [ID_NUMBER]"),
        ("passport A1234567, order of 20 and seed B12", "passport [ID_NUMBER], order of 20 and seed B12"),
        ("passports: passport A 1234567 and E 1234568", "passports: passport [ID_NUMBER] and [ID_NUMBER]"),
        ("order A1234567, passport B7654321", "order A1234567, passport [ID_NUMBER]"),
    ],
)
def test_lists_of_numbers(text, masked):
    assert mask(text, Finder()(text)) == masked


def test_long_list_of_numbers():
    text = "passports, or rather passport numbers: " + ", ".join(f"A{1234567 + i}" for i in range(50))
    assert [k for _, _, k in Finder()(text)] == ["id_number"] * 50


@pytest.mark.parametrize(
    "text,mention",
    [
        ("I asked Anna Li about it", "Anna Li"),
        ("then Thomas Long came", "Thomas Long"),
        ("then Mary Lane came", "Mary Lane"),
        ("Mein Name ist Priya Sharma, hallo", "Priya Sharma"),
        ("Kind regards,\nPriya Sharma", "Priya Sharma"),
        ("we spoke with Priya K. Sharma", "Priya K. Sharma"),
    ],
)
def test_short_and_unlisted_names(text, mention):
    assert [(text[a:b], k) for a, b, k in Finder()(text)] == [(mention, "name")]


@pytest.mark.parametrize("text", ["Anna Is late", "the shop on Mary Lane today", "anna li", "how long did thomas long for it", "Kind regards, the whole team"])
def test_no_short_names(text):
    assert Finder()(text) == []


def test_names_and_numbers_that_are_in_no_list():
    """Given names outside the list beside a cue, chains of names, numbers of any prefix and digits."""
    find = Finder()
    got = lambda text: [(text[a:b], k) for a, b, k in find(text)]
    assert got("Please contact Kevin Brown or Lisa Miller tomorrow.") == [("Kevin Brown", "name"), ("Lisa Miller", "name")]
    assert got("Brian Cooper wrote it") == [("Brian Cooper", "name")]
    assert got("I met Wei Zhang, Priya Sharma and Mohammed Khan there") == [
        ("Wei Zhang", "name"), ("Priya Sharma", "name"), ("Mohammed Khan", "name")
    ]
    assert got("his landlord Steven Wright called") == [("Steven Wright", "name")]
    for plain in ("the Manager Sketched Six Baskets", "we met Quillmere Orchard Festival staff", "contact the Old Mill", "He said so", "New York said no such thing"):
        assert not got(plain)
    assert got("four one two six seven three nine eight two one") == [("four one two six seven three nine eight two one", "phone")]
    assert got("my number AB 12 34 56 C is known") == [("AB 12 34 56 C", "id_number")]
    assert got("call (212) 555-0123 ext. 4, or +44 20 7946 0958") == [("(212) 555-0123 ext. 4", "phone"), ("+44 20 7946 0958", "phone")]

import random
import time

from pyspark.sql import functions as F

from vellora.llm import quality as ql
from vellora.llm.queries import Q
from vellora.llm.queries import strung_together as ql_huge_of

PROSE = [
    "Passt.", "Nice 👍", "Great!", "waste of money", "For camping I could not ask for more. Even my uncle asked where I got it.",
    "FÜR DAS GELD HÄTTE ICH MEHR ERWARTET.", "we use it at the office almost every day and the lid is solid i want my money back",
    "准备退货，滤网太吵了。发货很快，东西都齐全。<br>\n以后还会再买，主要是轮子做工不错。 &amp; more",
    "En la foto parecía otra cosa. No lo recomiendo.\nhttp://pics.example.invalid/735013",
    "It fits. I like it. My sister asked for it. We use it a lot. It is fine for us.\n- spout\n- lid", "Das ist gut !!! Ich bin zufrieden !!! Alles war dabei !!!",
    "> quoted line of 12 words that goes on\n> and 14 more of the same kind with\n> nothing else in it at all, which is\n> prose of the usual kind.",
]
LANGUAGES = [
    "Tuote oli juuri sellainen kuin odotin ja toimitus tuli ajoissa. Suosittelen tätä kaikille ystävilleni lämpimästi.",
    "Ürün tam beklediğim gibi çıktı ve kargo zamanında geldi. Bütün arkadaşlarıma gönül rahatlığıyla tavsiye ederim.",
    "배송이 정말 빠르고 품질도 생각보다 훨씬 좋았습니다. 친구들에게도 꼭 추천하고 싶은 제품입니다.",
    "思っていたよりも品質が良くて、配送もとても早かったです。友達にもおすすめしたいと思います。",
    "المنتج رائع جدا ووصل في الوقت المحدد تماما. أنصح جميع أصدقائي بشراء هذا المنتج دون تردد.",
    "Το προϊόν ήταν ακριβώς όπως το περίμενα και έφτασε στην ώρα του. Το συνιστώ σε όλους τους φίλους μου.",
    "Sản phẩm đúng như tôi mong đợi và giao hàng rất nhanh. Tôi sẽ giới thiệu cho tất cả bạn bè của mình.",
    "यह उत्पाद बिल्कुल वैसा ही है जैसा मैंने सोचा था और समय पर पहुँच गया। मैं इसे अपने सभी दोस्तों को सुझाऊँगा।",
    "A termék pontosan olyan volt, amilyennek vártam, és időben megérkezett. Minden barátomnak ajánlom.",
    "Zboží přišlo včas a přesně odpovídá popisu výrobce. Všem známým bych tento obchod vřele doporučil.",
    "Produsul este exact cum mă așteptam și livrarea a venit la timp. Îl recomand tuturor prietenilor mei.",
    "Barangnya sesuai dengan harapan saya dan pengiriman sangat cepat. Saya akan merekomendasikan kepada semua teman.",
    "Bidhaa hii ilikuwa nzuri sana kama nilivyotarajia na ilifika kwa wakati. Ninawapendekezea marafiki zangu wote.",
    "Roedd y cynnyrch yn union fel yr oeddwn yn ei ddisgwyl a daeth mewn pryd. Byddwn yn ei argymell i bawb.",
    "Toode vastas täielikult minu ootustele ning saabus õigel ajal. Soovitan seda kindlasti kõigile sõpradele.",
    "Prece pilnībā atbilda manām cerībām un tika piegādāta laikā. Noteikti ieteikšu visiem saviem draugiem.",
    "Produktua espero nuen bezalakoa zen eta garaiz iritsi zen. Nire lagun guztiei gomendatuko diet.",
    "สินค้าดีมากตรงตามที่คาดหวังไว้และจัดส่งรวดเร็ว ขอแนะนำให้เพื่อนทุกคนลองซื้อดู",
    "המוצר היה בדיוק כמו שציפיתי והגיע בזמן. אני ממליץ עליו לכל החברים שלי בלי היסוס.",
    "Proizvod je bio točno onakav kakav sam očekivao i stigao je na vrijeme. Preporučujem ga svim prijateljima.",
    "Produkt okazał się dokładnie taki, jakiego oczekiwałem, przyszedł wcześniej. Wszystkim znajomym szczerze polecam sklep.",
    "Varan levererades snabbt enligt överenskommelse. Kvaliteten motsvarade förväntningarna fullständigt.",
]
OTHER = {
    "list": ["- lid\n- pump: loose\n- strap 3 g\n- case\n- cable", "I like it all in all.\n1. lid\n2. pump\n3. strap\n4. case\n5. seam\nBof.", "lid: 3\npump = loose\nstrap: 7\ncase: 9", "[x] 开关\n[x] 电池\n[x] 电机: 太吵了\n[x] 抽屉 3 g"],
    "table": ["item\tqty\tprice\nlid\t3\t4\npump\t5\t6\ncase\t7\t8", '"item";"qty"\n"lid";"3"\n"pump";"4"\n"case";"5"', "| a | b |\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |", "item,qty,price\nlid,3,4\npump,4,5\ncase,5,6", "item      qty     price\nlid       3       4\npump      4       5\ncase      5       6"],
    "junk": [
        "zglqw krrriiwh ojiuhs akuhuuol aow hfkedrzfu freie olaaiatuzd jegg", "best sale sale best deal sale best deal best sale deal best sale sale best",
        "glY4HrXVRACNLQqq2n27trCAd+u6Hm82rc1/jvubOnzu+mNU572bITsF3V30lKuw56w1m0nuyE092", '<div class="c63"><span style="top:25px"></span></div><div class="c33"></div>{{review.body}}',
        "... - ... - ... - ... - ... - ... - ", "🔥💯👍💯😂❗⭐😂😡👍🎉🔥❗🎉😂😡😡💯", "#salenow #dealwin #kettlelove #sale #tool", "784855682 09da0a 149620102\n646776462 077c58 826321788",
        "deal\n" * 20 + "waste of money", "http://a.example.invalid/x http://b.example.invalid/y http://c.example.invalid/z",
        "PÃ…Â\x93ur mÃ…Â\x93i, lÃ\x83Â© tirÃ…Â\x93ir rÃ\x83Â©stÃ\x83Â© impÃ\x83Â©ccÃ\x83Â¼blÃ\x83Â©",
    ],
}


def kind(t):
    return ql.outcomes(*ql.tallies([t]))[-1][0]


def test_rules():
    assert [t for t in PROSE if kind(t) != "prose"] == []
    assert [(k, t) for k, ts in OTHER.items() for t in ts if kind(t) != k] == []
    assert kind("") == kind(" \n\t") == "blank"


def test_prose_of_languages_without_a_word_list():
    assert [t for t in LANGUAGES if kind(t) != "prose"] == []


def through_chunks(t, cuts):
    """The sums of a text by chunks with the given borders, through packed states."""
    parts = ql.states([t[a:b] for a, b in zip(cuts, cuts[1:])])
    return ql.merged([ql.State.unpack(p.pack()) for p in parts]).done()


def random_cuts(rng, t, most):
    return sorted({0, len(t), *(c for c in (rng.randrange(len(t) + 1) for _ in range(rng.randrange(most))) if t[c - 1 : c + 1] != "\r\n")})


BITS = ["a", "Zé", "中", "の", " ", "   ", "    ", "\t", "\n", "\r\n", "\r", ".", "...", "。", "!\"", ",", ";", "|", "@", "a@b", ".c", "<", "</", "/>", "=\"", "{{", "#", "www", ".", "http", "s://", "Ã", "\x83", "\xa0", "�", "qz", "strk", "the", "1", "_", "👍", "x" * 31, "\u0301", ":", " = "]


def test_every_count_is_that_of_the_uncut_text():
    rng = random.Random(7)
    texts = PROSE + LANGUAGES + [t for ts in OTHER.values() for t in ts]
    for round_ in range(400):
        if round_ % 2:
            t = "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 60)))
        else:
            t = rng.choice(["\n", " ", "\r\n", ""]).join(rng.choice(texts) for _ in range(rng.randrange(1, 8)))
        n, h, k = through_chunks(t, random_cuts(rng, t, 12 if round_ % 3 else 60))
        m, g, j = (x[0] for x in ql.tallies([t], chunk=10**9))
        assert dict(zip(ql.COUNTS, n.tolist())) == dict(zip(ql.COUNTS, m.tolist())), t
        assert (h == g).all() and (k == j).all(), t


def test_many_texts_at_once_are_counted_like_each():
    texts = PROSE + ["", "\r", "\n\n", "x\r", "\n"] + LANGUAGES
    together = ql.tallies(texts)
    for i, t in enumerate(texts):
        assert all((a[i] == b[0]).all() for a, b in zip(together, ql.tallies([t])))


def test_operator(spark):
    rows = [(i, t, "clash") for i, t in enumerate(PROSE + [None, "", "I like it and it is good. " * 900, "- lid\n- pump\n" * 900])]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    whole = sorted(map(tuple, ql.text_statistics(df, "doc_id", "text", chunk=10**9).collect()))
    assert whole == sorted(map(tuple, ql.text_statistics(df, "doc_id", "text").collect()))
    assert whole == sorted(map(tuple, ql.text_statistics(df, "doc_id", "text", chunk=97, stretch=640, fan_in=4).collect()))
    assert [r[0] for r in whole] == [r[0] for r in rows if r[1] is not None]
    n, kinds = len(PROSE), {r[0]: r[-1] for r in whole}
    assert kinds[n + 1] == "blank" and kinds[n + 2] == "prose" and kinds[n + 3] == "list" and dict((r[0], r[2]) for r in whole)[n + 2] == 7 * 900
    assert ql.text_statistics(df.limit(0), "doc_id", "text").count() == 0


def test_against_labels(spark):
    d = "/root/testdata/sf0.01"
    votes = spark.read.parquet(f"{d}/labels.parquet").dropDuplicates().groupBy("doc_id").agg(F.avg("quality").alias("q")).filter("q <> 0.5")
    s = ql.text_statistics(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")
    r = s.join(votes, "doc_id").select(F.avg((F.col("prose") == (F.col("q") > 0.5)).cast("int")).alias("agree")).first()
    assert r.agree > 0.93  # raters err


def test_long_tokens_count_whole(spark):
    rng = random.Random(9)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    texts = []
    for size in (100, 300, 400, 513, 1000, 2061, 4000, 20000, 1000000):
        texts.append("".join(rng.choices(b64, k=size)))
        texts.append("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size)))
        texts.append("".join(rng.choices(han, k=size - 40)) + "battery，" + "".join(rng.choices(han, k=32)))
    for t in texts:
        m, g, j = (x[0] for x in ql.tallies([t], chunk=10**9))
        for cuts in ([], *(range(c, len(t), c) for c in (97, 640, 65536) if len(t) // c < 40), sorted(rng.sample(range(1, len(t)), 5))):
            n, h, k = through_chunks(t, [0, *cuts, len(t)])
            assert (n == m).all() and (h == g).all() and (k == j).all()
        c = dict(zip(ql.COUNTS, m.tolist()))
        assert c["tokens"] == 1 and c["chars"] == len(t)
        assert (c["long"], c["words"]) == (len(t), 0) if t.isascii() else c["cjk"] == g.sum() - 1 and c["words"] == 1
    rows = [(k, "Good. " * (k % 2) + t + tail) for k, t in enumerate(texts) for tail in ("", "\nend")] + [(99, "It is good and I like it. " * 9 + "x" * 5000)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = [sorted(map(tuple, ql.text_statistics(df, "doc_id", "text", chunk=c, stretch=s, fan_in=8).collect())) for c, s in ((640, 70000), (7000, 30000), (10**7, 10**7))]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    assert all(g[-1] == "junk" for g, (_, t) in zip(got[0], rows) if t.isascii() and "ood" not in t)


def test_long_tokens_take_linear_time():
    began = time.time()
    for t in ("@" * 1000000, "字" * 999990 + "<", "a_" * 500000 + "=字<b", "x" * 1000000, "a@" * 500000 + "."):
        ql.tallies([t], chunk=10**9)
    assert time.time() - began < 10
    links = lambda t: int(ql.tallies([t])[0][0, ql.C["links"]])
    assert [links(t) for t in ("a@b.c", "@b.c", "a@.c", "a@.c.d", "a@b@c.d", "www.x", "www.", "http://a", "a@b.")] == [1, 0, 0, 1, 1, 1, 0, 1, 0]


def test_huge_reviews(spark):
    """Reviews strung together above a stretch go through the tree of shuffles and come out as in one piece."""
    got = Q.queries["p7_huge"](spark, "/root/testdata/sf0.01").collect()
    want = []
    for r in ql_huge_of(spark, "/root/testdata/sf0.01").collect():
        o = ql.outcomes(*ql.tallies([r.text], chunk=10**9))
        want.append((r.volume, *(x[0] for x in o)))
    assert len(got) == len(want) > 1 and max(r.n_chars for r in got) > 65536
    key = lambda r: str(r[0])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[0] == b[0] and a[1] == b[1] and a[-1] == b[-1] and all(x is None and y != y or x == y for x, y in zip(a, b))

"""Generated sentences with personal data, and exact spans of what was filled in.

Everything drawn is a function of the row's key and the name of what is drawn, by a digest; so a rerun gives the same
sentences, each task draws for its own rows, and two draws of a row don't depend on each other."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import row

FIRST = "Adi Maya Hasan Nia Rudi Tika Bagus Citra Galih Intan".split()
LAST = "Pratama Sari Basri Kurnia Tan Wijaya Halim Utami Nasution Siregar".split()
#: What a form names in braces is drawn from these pools and number ranges (lowest, highest, digits).
POOLS = {
    "first": FIRST, "second": FIRST, "last": LAST, "street": ["Jl. Melati", "Jl. Kenanga", "Jalan Cemara", "Gang Mawar"],
    "village": "Sukamaju Karangsari Mekarwangi Tanjungrejo".split(), "town": "Jakarta Bandung Medan Bekasi Depok Semarang Palembang".split(),
    "sex": "pria wanita perempuan laki-laki".split(), "month": "Januari Februari Maret April Mei Juni Juli Agustus September Oktober November Desember".split(),
    "given": [x.lower() for x in FIRST], "family": [x.lower() for x in LAST], "tag": "toko arsip tim".split(),
    "host": "pos.example.id surat.example.com kantor.example.org".split(),
}
RANGES = {
    "house": (2, 640, 1), "day": (2, 27, 1), "month_no": (1, 12, 1), "year": (1955, 2019, 4), "short_year": (0, 99, 2), "number": (100, 999, 3),
    "carrier": (813, 858, 3), "block": (0, 9999, 4), "rest": (0, 999, 3), "area": (1101, 9471, 4), "born": (101, 7112, 4), "since": (0, 9999, 4), "serial": (1, 9999, 4),
}
#: Fixed, as the generated values' shares must be: of 10,000 values of a label, so many are below the number and take the
#: form beside it, the first that fits. The forms themselves are ours; each is one that the label's pattern or list finds.
FORMS = {
    "PER": [(2500, "{first}"), (3400, "{first} {second} {last}"), (10000, "{first} {last}")],
    "LOC": [(2000, "{street} No. {house}, {town}"), (3000, "Kelurahan {village}, {town}"), (10000, "{town}")],
    "DATE_TIME": [(4500, "{day} {month} {year}"), (6500, "{day}/{month_no}/{short_year}"), (8000, "{day} {month}"), (10000, "{day}-{month_no}-{year}")],
    "GENDER": [(10000, "{sex}")],
    "PHONE": [(3500, "0{carrier}{block}{rest}"), (6000, "+62 {carrier}.{block}.{rest}"), (8000, "62 {carrier} {block} {rest}"), (10000, "0{carrier}-{block}-{rest}")],
    "SSN": [(4000, "{area} {born} {since} {serial}"), (10000, "{area}{born}{since}{serial}")],
    "EMAIL": [(3000, "{given}.{family}@{host}"), (4500, "{family}_{number}@{host}"), (5500, "{tag}-{given}@{host}"), (10000, "{given}{number}@{host}")],
}
SENTENCES = [
    "Tiket kereta {DATE_TIME} dipesan {PER}, kursi dekat jendela {SSN}.",
    "Ojek menunggu di {LOC}; pengemudinya {PER}, seorang {GENDER}, {PHONE}.",
    "Catatan kasir: {PER}, bon lunas {DATE_TIME}, struk ke {EMAIL}.",
    "Bila hujan, acara pindah ke {LOC} dan {PHONE} tetap aktif.",
    "Formulir lama memakai {SSN}, yang baru memakai {EMAIL}.",
    "Juara lari {GENDER} ialah {PER}, hadiah diambil {DATE_TIME} dengan kupon {SSN}.",
    "Gudang {LOC} menitipkan kunci kepada {PER}, {PHONE}.",
    "Kode anggota {SSN} berlaku sampai {DATE_TIME}.",
    "Guru piano, {PER}, mengajar {DATE_TIME}; sewa ruang lewat {PHONE}.",
    "Ruang ganti {GENDER} di {LOC} dibuka dengan kode {SSN}.",
    "Ketua kelas {PER} menyimpan arsip {SSN}.",
    "Jangan jawab {EMAIL}, itu palsu; tanya {PER} di {PHONE}.",
    "Panggilan masuk {PHONE} pukul tujuh, {DATE_TIME}.",
    "Koper {GENDER} tertinggal di {LOC}, lapor {PHONE}.",
    "Pustakawan {PER} mengganti {EMAIL} sejak {DATE_TIME}.",
    "Denda atas {SSN} dibayar di {LOC}.",
    "Dua tamu, {PER} serta sepupunya yang {GENDER}, memakai kartu {SSN}.",
    "Grup {EMAIL} membahas banjir {LOC} sampai {PHONE} sibuk.",
    "Meja {PHONE} dan loker {SSN} milik toko yang sama.",
    "Arisan {DATE_TIME}: tuan rumah {PER}, {LOC}, kabari {PHONE} atau {EMAIL}.",
]
SHARES = 10_000


def parts_of(form: str) -> list[tuple[str, str | None]]:
    """(literal, name of the field after it or None) of a form, as str.format reads it."""
    return [(literal, name) for literal, name, _, _ in Formatter().parse(form)]


def draw(key: Column, name: str, n: int) -> Column:
    """A number below n."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(name)).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def field(key: Column, name: str) -> Column:
    if name in POOLS:
        return F.get(F.array(*[F.lit(x) for x in POOLS[name]]), draw(key, name, len(POOLS[name])))
    low, high, digits = RANGES[name]
    number = (draw(key, name, high - low + 1) + low).cast("string")
    return F.lpad(number, digits, "0") if digits > 1 else number


def value(label: str) -> Column:
    """The text of a label, of the row's drawn fields."""
    out = None
    for below, form in FORMS[label]:
        text = F.concat(*[x for literal, name in parts_of(form) for x in (F.lit(literal), *([F.col(name)] if name else []))])
        out = F.when(F.col(f"{label}?") < below, text) if out is None else out.when(F.col(f"{label}?") < below, text)
    return out


def used(name: str) -> Column:
    """Whether the form that a row's label takes, of any of its labels, names this field."""
    out = F.lit(False)
    for label, forms in FORMS.items():
        for (low, _), (below, form) in zip([(0, ""), *forms], forms, strict=False):
            if any(n == name for _, n in parts_of(form)):
                out = out | ((F.col(f"{label}?") >= low) & (F.col(f"{label}?") < below))
    return out


def pieces_of(sentence: str) -> Column:
    """array<struct<text, label>>: the sentence with its slots filled, cut at them."""
    out = []
    for literal, label in parts_of(sentence):
        if literal:
            out.append(row(text=F.lit(literal), label=F.lit(None).cast("string")))
        if label:
            out.append(row(text=F.col(label), label=F.lit(label)))
    return F.array(*out)


def gold_sentences(keys: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, entities) with exact offsets, one sentence a key; templates go round by key. A null key gives nulls.

    Only what a row's sentence and forms name is drawn; the other draws would not show."""
    k = F.col("doc_id")
    turn = F.pmod(k, F.lit(len(SENTENCES)))
    slots = {n: [i for i, x in enumerate(SENTENCES) if any(label == n for _, label in parts_of(x))] for n in FORMS}
    chosen_forms = [F.when(turn.isin(slots[n]), draw(k, f"{n}?", SHARES)).alias(f"{n}?") for n in FORMS]
    forms = keys.select(F.col(key).alias("doc_id")).select("doc_id", *chosen_forms)
    drawn = forms.select("doc_id", *[f"{n}?" for n in FORMS], *[F.when(used(n), field(k, n)).alias(n) for n in (*POOLS, *RANGES)])
    filled = drawn.select("doc_id", *[value(n).alias(n) for n in FORMS])
    chosen = F.when(turn == 0, pieces_of(SENTENCES[0]))
    for i, sentence in enumerate(SENTENCES[1:], 1):
        chosen = chosen.when(turn == i, pieces_of(sentence))
    rows = filled.select("doc_id", chosen.alias("p"))
    start = row(at=F.lit(0), out=F.array().cast("array<struct<start:int,end:int,label:string,text:string>>"))

    def add(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x["text"])
        own = F.array(row(start=a["at"], end=end, label=x["label"], text=x["text"]))
        return row(at=end, out=F.when(x["label"].isNull(), a["out"]).otherwise(F.concat(a["out"], own)))

    return rows.select("doc_id", F.array_join("p.text", "").alias("text"), F.aggregate("p", start, add, lambda a: a["out"]).alias("entities"))

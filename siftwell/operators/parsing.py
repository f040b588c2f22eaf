"""Tiered parsers: each item takes the strictest tier that fits, rejects stay visible.

Every parser turns (keys, text) into rows (keys, pos, ..., tier); tier counts are a groupBy.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Patterns of the tiers.
INFUSION = r"(?iuU)^\s*[\d.,/]+\s*(?:mg|g|ml|mcg|UI|U)\s+di\s+([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s\-]*?)\s*(?:\*|\s+in\s+\d|$)"
NAME_THEN_DOSE = r"(?uU)^\s*([^\d:]+?)\s*(?=\d)"
QUOTED = r'(?s)"(.*?)"'
FULL = r"(?suU)^\s*([^(:]+?)\s*\(([^()]*)\)\s*:\s*(.+)$"
SYNONYM = r"(?suU)^\s*([^(:]+?)\s*\(([^()]*)\)\s*\(([^()]*)\)\s*:?\s*(.*)$"
NO_BRAND = r"(?suU)^\s*([^(:]+?)\s*:\s*(.+)$"
NO_DOSAGE = r"(?suU)^\s*([^(:]+?)\s*\(([^()]*)\)\s*(.*)$"
NESTED = r"(?suU)^\s*([^(:]+?)\s*\(((?:[^()]|\([^()]*\))*)\)\s*:\s*(.+)$"
NAME_AND_DOSE = r"(?suU)^\s*([^\d(:]+?)\s*(?:da assumere\s*)?(\d.*)$"
ECHO = r"(?iuU)([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'\- ]{2,45}?)\s+(si|no)\s*(?=[.,;]|$)"
ALLERGIES = r"(?isuU)Allergie e intolleranze\s*:\s*(.*?)(?=\s(?:Anamnesi|Fattori|Comorbidit|Interventi|Diagnosi|APR|APF|Terapia)\b|$)"
NO_ALLERGIES = r"(?iuU)allergie e intolleranze non (note|compilate)"
ALLERGY_KIND = r"(?iuU)(Principi attivi|Alimenti|Mezzo di contrasto|Altro|Note)\s*(?:\(([^)]*)\))?"
DISCHARGE_WORDS = 12


def group(t: Column, pattern: str, i: int) -> Column:
    """A group of a matching pattern, trimmed; null where it does not match."""
    return F.when(t.rlike(pattern), F.trim(F.regexp_extract(t, pattern, i)))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once: later expressions that use them several times do not repeat them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def admission_items(df: DataFrame, text: str = "text") -> DataFrame:
    """Admission lists 'name: dose ; ...' -> rows with pos, item, name, tier."""
    keys = [c for c in df.columns if c != text]
    none = F.col(text).rlike(tx.NO_THERAPY)
    items = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*keys, none.alias("_none"), F.posexplode(F.when(none, F.array(F.lit(""))).otherwise(F.split(text, ";"))).alias("pos", "item"))
    item = F.trim(F.regexp_replace("item", r"(?uU)^\s+|\s+$", ""))
    items = items.withColumn("item", item).where("_none or item != ''")
    dosed = F.when(~tx.list_comma(F.col("item")), group(F.col("item"), NAME_THEN_DOSE, 1))
    items = settled(items, _infusion=group(F.col("item"), INFUSION, 1), _colon=F.when(F.contains("item", F.lit(":")), F.trim(F.substring_index("item", ":", 1))), _dosed=F.trim(F.regexp_replace(dosed, tx.TRAILING_FORM, "")))
    tier = (
        F.when(F.col("_none"), "none_declared").when(F.col("item").rlike(tx.NOT_A_DRUG), "excluded_not_a_drug").when(F.col("_infusion").isNotNull(), "2_infusion")
        .when(tx.plausible_name(F.col("_colon")), "1_name_and_dosage").when(tx.plausible_name(F.col("_dosed")), "3_name_then_dose").otherwise("rejected")
    )
    items = settled(items, tier=tier)
    name = F.when(F.col("tier") == "2_infusion", F.col("_infusion")).when(F.col("tier") == "1_name_and_dosage", F.col("_colon")).when(F.col("tier") == "3_name_then_dose", F.col("_dosed"))
    return items.select(*keys, "pos", "item", name.alias("name"), "tier")


def discharge_items(df: DataFrame, text: str = "text") -> DataFrame:
    """Quoted discharge items -> rows with pos, item, principle, synonym, brand, dosage, tier.

    Tiers are tried in the order 2, 1, 3, 4, 5, 6; one whose name is not plausible falls through.
    """
    keys = [c for c in df.columns if c != text]
    items = df.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))).alias("pos", "item")).withColumn("item", F.trim(F.regexp_replace("item", r"(?uU)^\s+|\s+$", ""))).where("item != ''")
    it = F.col("item")
    tiers = (("2_with_synonym", SYNONYM, (2, 3, 4)), ("1_full", FULL, (0, 2, 3)), ("3_no_brand", NO_BRAND, (0, 0, 2)), ("4_no_dosage", NO_DOSAGE, (0, 2, 3)), ("5_nested_brand", NESTED, (0, 2, 3)), ("6_name_and_dose", NAME_AND_DOSE, (0, 0, 2)))
    names = {f"_{tier[0]}": group(it, pattern, 1) for tier, pattern, _ in tiers}
    names["_6"] = F.trim(F.regexp_replace(names["_6"], tx.TRAILING_FORM, ""))
    items = settled(items, **names)
    best = F.when(it.rlike(tx.NOT_A_DRUG), "excluded_not_a_drug").when(F.trim(F.substring_index("item", "(", 1)).rlike(tx.PLACEHOLDER), "excluded_placeholder")
    for tier, _, _ in tiers:
        best = best.when(tx.plausible_name(F.col(f"_{tier[0]}"), DISCHARGE_WORDS), tier)
    rows = settled(items, tier=best.otherwise("rejected"))

    def part(k):
        out = F.lit(None).cast("string")
        for tier, pattern, groups in tiers:
            if groups[k]:
                out = F.when(F.col("tier") == tier, group(it, pattern, groups[k])).otherwise(out)
        return out

    principle = F.lit(None).cast("string")
    for tier, _, _ in tiers:
        principle = F.when(F.col("tier") == tier, F.col(f"_{tier[0]}")).otherwise(principle)
    return rows.select(*keys, "pos", "item", principle.alias("principle"), part(0).alias("synonym"), part(1).alias("brand"), part(2).alias("dosage"), "tier")


def questionnaire_echo(df: DataFrame, text: str = "text") -> DataFrame:
    """'<term> si' and '<term> no' -> rows with pos, term, polarity."""
    keys = [c for c in df.columns if c != text]
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(ECHO), F.lit(1)).alias("term"), F.regexp_extract_all(text, F.lit(ECHO), F.lit(2)).alias("polarity"))
    return df.select(*keys, F.posexplode(pairs).alias("pos", "x")).select(*keys, "pos", F.lower(F.trim("x.term")).alias("term"), F.lower("x.polarity").alias("polarity"))


def allergy_section(df: DataFrame, text: str = "text") -> DataFrame:
    """State of the section: section_absent, none_declared or present; with categories as a map."""
    keys = [c for c in df.columns if c != text]
    body = F.when(F.coalesce(F.col(text).rlike(ALLERGIES), F.lit(False)), F.trim(F.regexp_extract(text, ALLERGIES, 1)))
    rows = df.select(*keys, body.alias("body"))
    state = F.when(F.col("body").isNull(), "section_absent").when(F.col("body").rlike(NO_ALLERGIES), "none_declared").otherwise("present")
    pairs = F.arrays_zip(F.transform(F.regexp_extract_all("body", F.lit(ALLERGY_KIND), F.lit(1)), F.lower).alias("kind"), F.regexp_extract_all("body", F.lit(ALLERGY_KIND), F.lit(2)).alias("value"))
    return rows.withColumn("state", state).select(*keys, "state", F.when(F.col("state") == "present", pairs).alias("categories"))


def allergy_values(df: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """One row per allergen (values split at , and ;); coded only below active principles, and only with a map."""
    s = allergy_section(df, text)
    keys = [c for c in df.columns if c != text]
    v = s.select(*keys, F.explode("categories").alias("x")).select(*keys, F.col("x.kind").alias("kind"), F.explode(F.split("x.value", "[,;]")).alias("allergen")).withColumn("allergen", F.trim("allergen")).where("allergen != ''")
    if known is None:
        return v.withColumn("code", F.lit(None).cast("string"))
    return v.withColumn("form", F.when(F.col("kind").startswith("principi"), F.lower("allergen"))).join(known.select("form", "code"), "form", "left").drop("form")


def headings(df: DataFrame, text: str = "text", pattern: str = r"(?m)^([A-ZÀ-Ý][\p{L} ]{2,40}):") -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("heading")).groupBy("heading").agg(F.count("*").alias("n"))


# What is no condition, headings that stick to a fragment, measures and dates, hints of negation and doubt.
NARRATIVE = r"(?iuU)^(si ricovera|ricovero|si esegue|esegue|eseguit|effettuat|in data|viene |veniva |prosegue|riferisce|si segnala|come da|nella norma|paziente di|anamnesi|terapia|indicazione)"
STUCK_HEADING = r"(?iuU)^(fattori di rischio|comorbidit[aà]|interventi pregressi|anamnesi\s*\w*|diagnosi|allergie e intolleranze|apr|apf|terapia domiciliare|motivo del ricovero)\s*:\s*"
MEASURE_OR_DATE = r"\d{2}[./]\d{2}|\d+\s*(mg|ml|mm|cm|%|mmhg|bpm)"
HINTS = ("nega", "non ", "assenza di", "esclude", "si esclude", "escluso", "negativo per", "no ", "mai ", "sospetta", "sospetto", "possibile", "probabile", "verosimile", "dubbio")


def fragments(df: DataFrame, text: str = "text") -> DataFrame:
    """Candidate conditions: cut at '.' and ';', headings and outer punctuation off, 4 to 45 characters,
    no narrative, no measure or date. ``fragment`` is in lower case, ``form`` as it stands, ``pos`` its place."""
    keys = [c for c in df.columns if c != text]
    f = df.select(*keys, F.posexplode(F.split(text, r"[.;]\s+")).alias("pos", "form"))
    f = f.withColumn("form", F.regexp_replace(F.regexp_replace(F.trim("form"), STUCK_HEADING, ""), r"^[ .,;:-]+|[ .,;:-]+$", ""))
    f = f.where((F.length("form") > 3) & (F.length("form") <= 45) & ~F.col("form").rlike(NARRATIVE) & ~F.col("form").rlike(MEASURE_OR_DATE))
    return f.select(*keys, "pos", "form", F.lower("form").alias("fragment"))


def hints(item: str) -> object:
    """Hints of negation and doubt that a form begins with, sorted."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(item).startswith(h), F.lit(h.strip())) for h in HINTS]))), ",")


def vocabulary(df: DataFrame, key: str, item: str, context: str, least: int = 3, place: tuple[str, ...] = ()) -> DataFrame:
    """(item, n, n_records, contexts): counts, and the first three contexts in order of record and place, over a threshold.

    Only the three least contexts of each item are ever held: they are cut before they are gathered.
    """
    order = [key, *place, context]
    first = df.select(item, *dict.fromkeys(order)).withColumn("_n", F.row_number().over(Window.partitionBy(item).orderBy(*order))).where("_n <= 3")
    shown = first.groupBy(item).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", context))), lambda x: x[context]), "|").alias("contexts"))
    counts = df.groupBy(item).agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_records")).where(F.col("n") >= least)
    return counts.join(shown, item)


def drug_vocabulary(items: DataFrame, confirmations: DataFrame) -> DataFrame:
    """items(enc, field, name, principle or null) -> one row per brand root.

    n and distinct records in each field, variants, the prevailing principle (most uses, ties by name) and
    the outcome against confirmations(root, substances): not_found, not_verified without a principle,
    confirmed if every longer word of it begins some substance, else discordant.
    """
    i = items.withColumn("root", tx.brand_root(F.col("name"))).where("root != ''")
    by_field = i.groupBy("root", "field").agg(F.count("*").alias("n"), F.countDistinct("enc").alias("n_records"), F.collect_set("name").alias("names"))
    g = by_field.groupBy("root").agg(
        F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "field", "n", "n_records"))), "|").alias("fields"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), "|").alias("variants"))
    uses = i.where("principle is not null").groupBy("root", "principle").agg(F.count("*").alias("k"))
    best = uses.groupBy("root").agg(F.min(F.struct((-F.col("k")).alias("k"), "principle")).alias("b")).select("root", F.col("b.principle").alias("principle"))
    j = g.join(best, "root", "left").join(confirmations.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set(F.lower("substances"))), " | ").alias("subs")), "root", "left")
    words = F.filter(F.split(tx.normal_ascii(F.col("principle")), "[/ ]+"), lambda w: F.length(w) >= 5)
    ok = (F.size(words) > 0) & F.forall(words, lambda w: F.contains("subs", F.substring(w, 1, 6)))
    outcome = F.when(F.col("subs").isNull(), "not_found").when(F.col("principle").isNull(), "not_verified").when(ok, "confirmed").otherwise("discordant")
    return j.select("root", "n", "fields", "variants", "principle", outcome.alias("outcome"))


# Lines of a printed code list, and instructions to coders.
CHAPTER = re.compile(r"^\s*Capitolo ([IVXL]+)\s*-\s*(.+?)\s*$")
SERVICE = re.compile(r"^\s*(\d+\s+)?Centro Collaboratore|^\s*ICD-10 2019\s*$|^\s*$")
ENTRY = (("subcategory", re.compile(r"^([A-Z]\d{2}\.\d)(?:†)?\s{2,}(\S.*)$")), ("category", re.compile(r"^ {1,3}([A-Z]\d{2})(?:†)?\s{2,}(\S.*)$")))
BLOCK = (("included", re.compile(r"^\s*Incl\.\s*:\s*(.*)$")), ("excluded", re.compile(r"^\s*Escl\.\s*:\s*(.*)$")))
BULLET = re.compile("^\\s*[\uf0b7\uf0a7\u26ac\u2022]\\s*(.*)$")
BRACE = re.compile(r"^(.*?\S)\s{3,}(\S.*)$")
REFERENCE = re.compile(r"\s*\([A-Z]\d{2}[^)]*\)\s*$")
INSTRUCTION = re.compile(r"^(utilizzare|usare|codificare|questa categoria|questo capitolo|nota|include|comprende|per |se si desidera|i codici|il codice)\b", re.I)


def printed_term(text: str) -> str:
    """A term without references to codes, dagger, asterisk and outer punctuation."""
    return re.sub(r"\s+", " ", re.sub("[†*]", "", REFERENCE.sub("", text))).strip(" ,;:.")


class _CodeList:
    """Reads the lines of one printed list. ``open`` holds bullets until their group ends, as a brace
    printed beside any of them stands for all."""

    def __init__(self):
        self.entries, self.chapter, self.code = {}, None, None
        self._reset(None)

    def _reset(self, block):
        self.block, self.prefix, self.note, self.open, self.brace = block, "", False, [], ""

    def _add(self, text: str) -> None:
        term = printed_term(text)
        terms = self.entries[self.code][self.block]
        if len(term) >= 3 and not INSTRUCTION.match(term) and term not in terms:
            terms.append(term)

    def _close(self) -> None:
        for prefix, term in self.open:
            self._add(" ".join(x for x in (prefix, term, self.brace) if x))
        self.open, self.brace = [], ""

    def line(self, line: str) -> None:
        line = line.replace("\x0c", "")
        chapter = CHAPTER.match(line)
        if chapter:
            self.chapter = " - ".join(chapter.groups())
        if chapter or SERVICE.match(line):
            return
        for level, pattern in ENTRY:
            m = pattern.match(line)
            if m:
                self._close()
                self.code = m[1]
                # an entry that is printed twice is one entry: its first title stays
                self.entries.setdefault(m[1], {"level": level, "chapter": self.chapter, "title": printed_term(m[2]), "included": [], "excluded": []})
                return self._reset(None)
        if self.code is None:
            return
        for block, pattern in BLOCK:
            m = pattern.match(line)
            if m:
                self._close()
                self._reset(block)
                return self._text(m[1].strip())
        if self.block is None:
            return
        m = BULLET.match(line)
        if m:
            self.note = False
            return self._bullet(m[1].strip())
        self._close()
        text = line.strip()
        if INSTRUCTION.match(text):
            self.note = True
        elif not self.note and not text.startswith(("Incl", "Escl")):
            self._text(text)

    def _text(self, text: str) -> None:
        """A term, or with a colon the prefix of the list that follows."""
        if text.endswith(":"):
            self.prefix = text[:-1].strip()
        elif text:
            self._add(text)

    def _bullet(self, text: str) -> None:
        if text.endswith(":"):  # a list within the list
            self.prefix, self.open, self.brace = f"{self.prefix} {text[:-1]}".strip(), [], ""
            return
        m = BRACE.match(text)
        if m:
            text, self.brace = m[1].strip(), m[2].strip()
        self.open.append((self.prefix, text))


def code_list(lines) -> dict:
    """code -> level, chapter, title, included, excluded, from a printed list's lines in order."""
    reader = _CodeList()
    for line in lines:
        reader.line(line)
    if reader.code is not None and reader.block:
        reader._close()
    return reader.entries


def terminology_blocks(lines: DataFrame, book: str | None = None) -> DataFrame:
    """(line_no, line) of printed code lists -> (code, level, chapter, title, included, excluded).

    What a line means hangs on all lines before it, so a book is read in order by one task; with a
    ``book`` column several books (or volumes) are read side by side.
    """
    key = F.col(book) if book else F.lit("")
    rows = lines.select(key.cast("string").alias("book"), "line_no", "line").repartition("book").sortWithinPartitions("book", "line_no")

    def run(batches):
        now, held = None, []

        def flush():
            got = code_list(held)
            names = ("level", "chapter", "title", "included", "excluded")
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(got), pa.string()), pa.array(list(got), pa.string()), *[pa.array([e[n] for e in got.values()], k) for n, k in zip(names, kinds)]], names=["book", "code", *names])

        for batch in batches:
            for b, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if b != now:
                    if held:
                        yield flush()
                    now, held = b, []
                held.append(line or "")
        if held:
            yield flush()

    out = rows.mapInArrow(run, "book string, code string, level string, chapter string, title string, included array<string>, excluded array<string>")
    return out.withColumnRenamed("book", book) if book else out.drop("book")


def term_index(terms: DataFrame, shortest: int = 4) -> DataFrame:
    """(term, code) rows -> term and its sorted codes."""
    return terms.where(F.length("term") >= shortest).groupBy("term").agg(F.array_sort(F.collect_set("code")).alias("codes"))

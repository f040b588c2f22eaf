"""Column functions over text: normal forms, guards, anchors. All stay in the JVM.

Patterns carry (?uU) so that classes and case folding are Unicode's, and (?i) where case is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and word lists of the guards.
NOT_A_DRUG = r"(?iuU)^\s*(ossigeno|cicli|cpap|c-pap|niv|ventilazione|maschera)\b"
PLACEHOLDER = r"(?iuU)^\s*(nessun\s+principio\s+attivo|n\.?d\.?|non\s+specificat\w*|-+)\s*$"
NO_THERAPY = r"(?iuU)^\s*(nessuna\s+terapia|non\s+assume|nessun\s+farmaco|nulla)\b"
DOSAGE_IN_NAME = r"(?iuU)\b(mg|mcg|gr?|ml|ui|u|cp|cpr|cps|cpz|gtt|fl|bust|puff|ore|die|al|alle)\b"
TRAILING_FORM = r"(?iuU)\s+(?:cp|cpr|cps|cpz|cp\.riv|cpr\.riv|compresse?|capsule?|gtt|fl|fiale?|bust|puff|soluz|scir|crema|cerotti?)\.?$"
BRAND_FORM = r"(?iuU)\s+(cp|cpr|cps|cpz|compresse|soluz|grat|scir|gtt|spray|puff|polv|cerotto|fl|bust|crema|ung|collirio|sosp|sciroppo)\b.*$"
BRAND_DOSE = r"(?iuU)\s+[\d.,/]+\s*(mg|mcg|g|ml|ui|u)\b.*$"
ATC_CODE = r"^[A-Z]\d{2}([A-Z]([A-Z](\d{2})?)?)?$"
UNITS = ("mg", "mcg", "g", "gr", "ml", "ui", "u", "cp", "cpr", "cps", "cpz", "gtt", "fl", "bust", "puff", "ore", "die", "al", "alle", "riv", "gastr", "rp", "sc", "ev", "os")
INADMISSIBLE = r"(?iuU)^\d|^(altr|non specificat|specificat|senza|con |sequele|altre forme)|\bs\.a\.i\b|\bogni condizione\b"
GENERIC = (
    "dolore", "febbre", "tosse", "nausea", "vomito", "cefalea", "astenia", "edema", "edemi", "shock", "coma", "morte", "aborto", "parto", "nascita", "gravidanza", "frattura",
    "ferita", "ustione", "avvelenamento", "contusione", "lesione", "lesioni", "tumore", "cisti", "polipo", "ulcera", "ernia", "stenosi", "occlusione", "emorragia", "infezione", "ascesso", "anemia",
)
LEADING_QUALIFIER = r"(?iuU)^(altro|altra|altri|altre|altre forme di|altri disturbi del|altre malattie del|altri)\s+"
CLOSING_QUALIFIER = r"(?iuU)[, ]+(non specificat\w+|s\.a\.i\.?|nas|di altro tipo|non altrimenti specificat\w+)\s*$"


def normal_ascii(t: Column) -> Column:
    """Lower case; all but a-z, 0-9, blank and slash becomes a blank (accented letters too)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), "[^a-z0-9/ ]", " "), r"\s+", " "))


def normal_unicode(t: Column) -> Column:
    """Outer punctuation off, white space collapsed, lower case; accents stay."""
    inner = F.regexp_replace(t, r"(?uU)^[\s.,;:()\[\]'\"-]+|[\s.,;:()\[\]'\"-]+$", "")
    return F.lower(F.regexp_replace(inner, r"(?uU)\s+", " "))


def normal_words(t: Column) -> Column:
    """Word characters only, single blanks: for containment tests."""
    return F.trim(F.regexp_replace(F.lower(t), r"(?uU)[^\w]+", " "))


def faithful(passed: Column, original: Column) -> Column:
    """Does the original contain what was passed on?"""
    return F.contains(normal_words(original), normal_words(passed))


def plausible_name(name: Column, most_words: int = 4) -> Column:
    """Looks like a drug's name: starts with a letter, no comma, no dosage, not too many words."""
    n = F.trim(name)
    return n.isNotNull() & n.rlike(r"(?uU)^\p{L}") & ~n.rlike(PLACEHOLDER) & ~F.contains(n, F.lit(",")) & ~n.rlike(DOSAGE_IN_NAME) & (F.size(F.split(n, r"(?uU)\s+")) <= most_words)


def list_comma(t: Column) -> Column:
    """Has it a comma that is not a decimal one?"""
    return F.contains(F.regexp_replace(t, r"(?<=\d),(?=\d)", ""), F.lit(","))


def brand_root(t: Column) -> Column:
    """A brand's comparable root: no form, no dose, lower case."""
    return F.trim(F.lower(F.regexp_replace(F.trim(F.regexp_replace(t, BRAND_FORM, "")), BRAND_DOSE, "")))


def clean_term(t: Column) -> Column:
    """A terminology term without a closing reference to codes, dagger, asterisk and outer punctuation."""
    t = F.regexp_replace(t, r"(?uU)\s*\([A-Z]\d{2}[^)]*\)\s*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[†*]", ""), r"(?uU)\s+", " "), r"^[ ,;:.]+|[ ,;:.]+$", "")


def admissible_form(t: Column) -> Column:
    """Four characters or more, with a word of three letters or more that is no unit or form."""
    f = F.trim(t)
    return (F.length(f) >= 4) & F.exists(F.split(F.lower(f), r"[\s/,+.\-]+"), lambda p: (F.length(p) >= 3) & p.rlike(r"(?uU)^\p{L}+$") & ~p.isin(*UNITS))


def admissible_term(t: Column, shortest: int = 5, most_words: int = 6) -> Column:
    """Long enough, not too many words, no residual wording, and not one of the generic words."""
    return (F.length(t) >= shortest) & (F.size(F.split(F.trim(t), r"(?uU)\s+")) <= most_words) & ~t.rlike(INADMISSIBLE) & ~t.isin(*GENERIC)


def anchor(text: Column, quote: Column) -> Column:
    """0-based place of a quote: exact, else ignoring case, else null."""
    at = lambda a, b: F.nullif(F.instr(a, b), F.lit(0))
    return F.coalesce(at(text, quote), at(F.lower(text), F.lower(quote))) - 1


def expand_parentheses(t: Column) -> Column:
    """A term with its optional parts: without any, each alone, all. Parts that hold a code are references and go."""
    squeeze = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?uU)\s+", " "), r"^[ ,;:]+|[ ,;:]+$", "")
    t = F.regexp_replace(t, r"\([^()]*[A-Z]\d{2}[^()]*\)", " ")
    parts = F.regexp_extract_all(t, F.lit(r"\(([^()]*)\)"), F.lit(1))
    none = squeeze(F.regexp_replace(t, r"\([^()]*\)", " "))
    every = squeeze(F.regexp_replace(t, r"[()]", " "))
    each = F.transform(parts, lambda p: squeeze(F.regexp_replace(F.replace(t, F.concat(F.lit("("), p, F.lit(")")), p), r"\([^()]*\)", " ")))
    return F.array_distinct(F.filter(F.concat(F.array(none), each, F.array(every)), lambda x: x != ""))


def derived_variants(t: Column) -> Column:
    """Up to three rounds of dropping residual qualifiers at the end and the beginning; only forms that differ."""
    cut = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, CLOSING_QUALIFIER, "")), LEADING_QUALIFIER, ""))
    one, two = cut(t), cut(cut(t))
    return F.array_except(F.filter(F.array_distinct(F.array(one, two, cut(two))), lambda x: x != ""), F.array(t))


def dictionary_forms(terms: DataFrame, titles: DataFrame) -> DataFrame:
    """terms(term, code) -> (form, codes): admissible terms and their variants; a form of one word only if it is a category's title.

    titles(title), which count with their variants.
    """
    known = titles.select(F.lower(F.trim("title")).alias("title"))
    known = known.select(F.explode(F.concat(F.array("title"), derived_variants(F.col("title")))).alias("form")).distinct()
    every = terms.select("code", F.explode(F.concat(F.array("term"), derived_variants(F.col("term")))).alias("form")).where(admissible_term(F.col("form")))
    one = F.size(F.split("form", r"\s+")) == 1
    kept = every.where(~one).unionByName(every.where(one).join(known, "form", "left_semi"))
    return kept.groupBy("form").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def drug_forms(items: DataFrame) -> DataFrame:
    """items(form, code or null, candidates or null) -> (form, codes): lower-cased admissible forms; those without a code stay."""
    rows = items.where(admissible_form(F.col("form"))).select(F.lower(F.trim("form")).alias("form"), F.when(F.col("code").isNotNull(), F.array("code")).otherwise(F.col("candidates")).alias("c"))
    return rows.select("form", F.explode_outer("c").alias("code")).groupBy("form").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))

"""Messages in several languages: negotiation, plural forms and placeholders as column expressions.

A catalog is a small dictionary that comes with the code, so it is compiled
into the expression: language, key and plural form are looked up by rows, along
a chain of fallbacks, and no row leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "en"
# Languages and the classes of their plural rules.
ONE_IS_ONE, ZERO_IS_ONE, SLAVIC = ("en", "de", "nl", "it", "es"), ("fr", "pt-BR"), ("pl",)
LANGUAGES = (*ONE_IS_ONE, *ZERO_IS_ONE, *SLAVIC)
PLACEHOLDER = r"\{[A-Za-z0-9_]+\}"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def negotiate(locale, languages: tuple[str, ...] = LANGUAGES, default: str = DEFAULT) -> Column:
    """The language of a locale such as de_AT.UTF-8: its whole tag, else what it begins with, else the default."""
    c = F.col(locale) if isinstance(locale, str) else locale
    tag = F.lower(F.translate(F.regexp_extract(F.coalesce(c, F.lit("")), r"^[^.@]*", 0), "_", "-"))
    whole = _map({x.lower(): x for x in languages})
    begins = _map({x.lower().partition("-")[0]: x for x in reversed(languages)})
    return F.coalesce(F.try_element_at(whole, tag), F.try_element_at(begins, F.substring_index(tag, "-", 1)), F.lit(default))


def plural(language, n) -> Column:
    """one, few, many or other: the plural form of a count in a language."""
    lang, count = (F.col(x) if isinstance(x, str) else x for x in (language, n))
    few = (count % 10).between(2, 4) & ~(count % 100).between(12, 14)
    slavic = F.when(count == 1, "one").when(few, "few").otherwise("many")
    return (
        F.when(lang.isin(*SLAVIC), slavic)
        .when(lang.isin(*ZERO_IS_ONE), F.when(count <= 1, "one").otherwise("other"))
        .otherwise(F.when(count == 1, "one").otherwise("other"))
    )


def filled(template, values: dict[str, Column]) -> Column:
    """The template with {name} by its value; names without one, and other braces, stay.  Values aren't looked through again."""
    t = F.col(template) if isinstance(template, str) else template
    if not values:
        return t
    known = F.create_map(*[x for name, value in values.items() for x in (F.lit("{" + name + "}"), value.cast("string"))])
    pieces = F.regexp_extract_all(t, F.lit(rf"{PLACEHOLDER}|[^{{]+|\{{"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")


@dataclass(frozen=True)
class Messages:
    """texts: language -> key -> template; those of counts have a key for each form, such as machines.one."""

    texts: dict[str, dict[str, str]]
    default: str = DEFAULT

    def _lookup(self, language: Column, key: Column) -> Column:
        flat = _map({f"{lang}\x1f{key}": t for lang, own in self.texts.items() for key, t in own.items()})
        at = lambda lang: F.try_element_at(flat, F.concat(lang, F.lit("\x1f"), key))
        return F.coalesce(at(language), at(F.lit(self.default)))

    def text(self, language, key, **values: Column) -> Column:
        """The message in the language, else in the default one, else its key."""
        lang, k = (F.col(x) if isinstance(x, str) else x for x in (language, key))
        return filled(F.coalesce(self._lookup(lang, k), k), values)

    def counted(self, language, key, n, **values: Column) -> Column:
        """The message for a count: its form's, else `other`'s, in the language and then in the default one; {n} is the count."""
        lang, k, count = (F.col(x) if isinstance(x, str) else x for x in (language, key, n))
        flat = _map({f"{x}\x1f{name}": t for x, own in self.texts.items() for name, t in own.items()})

        def at(x: Column) -> Column:
            return F.coalesce(*[F.try_element_at(flat, F.concat(x, F.lit("\x1f"), k, F.lit("."), form)) for form in (plural(x, count), F.lit("other"))])

        return filled(F.coalesce(at(lang), at(F.lit(self.default)), k), {"n": count, **values})


#: Texts of the report's counts.
REPORT = Messages(
    {
        "en": {"machines.one": "{n} machine", "machines.other": "{n} machines", "findings.one": "{n} finding on {host}", "findings.other": "{n} findings on {host}"},
        "de": {"machines.one": "{n} Rechner", "machines.other": "{n} Rechner", "findings.one": "{n} Fund auf {host}", "findings.other": "{n} Funde auf {host}"},
        "fr": {"machines.one": "{n} machine", "machines.other": "{n} machines"},
        "pl": {"machines.one": "{n} maszyna", "machines.few": "{n} maszyny", "machines.many": "{n} maszyn"},
    }
)

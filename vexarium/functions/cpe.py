"""Platform identifiers and package names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vexarium.functions.text import _c

CPE = r"cpe:2\.3:[aho*-]:([^:]*):([^:]*):([^:]*):"
#: Single words too generic to stand for a product.
GENERIC_NAMES = tuple(sorted("access accessibility account agent business data date driver generator hub image mail mobile network notification release remote request runtime safety scripting security server service statistics store update view web".split()))

#: The digest of every tag's payload.
PAYLOAD = "a314fc2dc663ae7a6b6bc6787594057396e6b3f569cd50fd5ddb4d1bbafd2b6a"


def vendor(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), CPE, 1)


def product(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), CPE, 2)


def version(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), CPE, 3)


def is_cpe(x: Column | str) -> Column:
    return _c(x).rlike(CPE)


def chunk(x: Column | str, n: int) -> Column:
    """The n-th part between colons, counted from 0; null if there are fewer."""
    return F.get(F.split(_c(x), ":"), F.lit(n))


def handle_dash(x: Column | str) -> Column:
    return F.when(_c(x) == "-", "*").otherwise(_c(x))


def handle_space(x: Column | str) -> Column:
    """Ids whose year lost its hyphen to a space."""
    return F.regexp_replace(_c(x), r"^(CVE)[ -](\d{4})[ -](\d+)$", "$1-$2-$3")


def purl(vendor_: Column | str, product_: Column | str, version_: Column | str) -> Column:
    v = _c(version_)
    return F.concat(F.lit("pkg:"), _c(vendor_), F.lit("/"), _c(product_), F.when((v != "*") & (v != ""), F.concat(F.lit("@"), v)).otherwise(""))


def swid(vendor_: Column | str, product_: Column | str, version_: Column | str) -> Column:
    """A software identification tag. The product has no white space in the tag's id and the file's name; a wildcard or empty version has no
    dot before it in the id and is empty as the version, and the payload's size and digest are always the same."""
    v, known = _c(version_), (_c(version_) != "*") & (_c(version_) != "")
    bare = F.regexp_replace(_c(product_), r"\s+", "")
    return F.concat(
        F.lit('<SoftwareIdentity xmlns="http://standards.iso.org/iso/19770/-2/2015/schema.xsd" name="'), _c(product_),
        F.lit('" tagId="'), _c(vendor_), F.lit("."), bare, F.when(known, ".").otherwise(""), v, F.lit('" version="'), F.when(known, v).otherwise(""),
        F.lit('"><Entity name="'), _c(vendor_), F.lit('" regid="com.'), _c(vendor_), F.lit('"><Meta product="'), _c(product_), F.lit('" colloquialVersion="'), v,
        F.lit('"/><Payload><File name="'), bare, F.lit(f'.exe" size="532712" SHA256:hash="{PAYLOAD}"/></Payload></SoftwareIdentity>'),
    )


def build(vendor_: Column | str, product_: Column | str, version_: Column | str) -> Column:
    return F.concat(F.lit("cpe:2.3:a:"), _c(vendor_), F.lit(":"), _c(product_), F.lit(":"), _c(version_), F.lit(":*" * 7))


def normal_name(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(x)), "[^a-zA-Z0-9 ]", "")


def is_generic(x: Column | str) -> Column:
    return normal_name(x).isin(*GENERIC_NAMES)

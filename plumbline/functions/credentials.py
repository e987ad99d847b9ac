"""Access keys: made, taken apart and compared as Column expressions; of a key its digest alone is stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def new_key(prefix: str, ident: Column | None = None, secret: Column | None = None) -> Column:
    """(id, plaintext, hash, suffix) of ``prefix_id_secret``; without a secret 32 random bytes as URL-safe base 64."""
    ident = F.uuid() if ident is None else ident
    if secret is None:
        secret = F.translate(F.rtrim(F.base64(F.unhex(F.sha2(F.concat(F.uuid(), F.uuid()), 256))), F.lit("=")), "+/", "-_")
    made = F.transform(F.array(F.struct(ident.alias("id"), secret.alias("secret"))), lambda x: F.struct(x["id"].alias("id"), F.concat_ws("_", F.lit(prefix), x["id"], x["secret"]).alias("plaintext")))[0]
    return F.transform(F.array(made), lambda x: F.struct(x["id"].alias("id"), x["plaintext"].alias("plaintext"), F.sha2(x["plaintext"], 256).alias("hash"), F.right(x["plaintext"], F.lit(4)).alias("suffix")))[0]


def parse_key(raw: Column, prefix: str) -> Column:
    """(id, plaintext) of a key of the right shape, null for anything else. The id ends at the first underscore; the secret may have some."""
    shape = rf"^{prefix}_({_ID})_[A-Za-z0-9_-]{{16,128}}$"
    return F.when(raw.rlike(shape) & (F.length(raw) <= 256), F.struct(F.regexp_extract(raw, shape, 1).alias("id"), raw.alias("plaintext")))


def same_digest(a: Column, b: Column) -> Column:
    """Equality of two texts in a time that depends on their length alone."""
    gaps = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.ascii(x).bitwiseXOR(F.ascii(y)))
    return F.when(F.length(a) != F.length(b), False).otherwise(F.aggregate(gaps, F.lit(0), lambda acc, x: acc.bitwiseOR(x)) == 0)

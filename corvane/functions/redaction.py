"""Redaction of nested columns: structs, arrays and maps are rebuilt by their schema, whatever their depth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Marks, the token form, the data URL form and the names of secret fields.
MARK, IMAGE_MARK = "[REDACTED]", "[REDACTED_BASE64_IMAGE]"
TOKEN = r"(?<![A-Za-z0-9_-])sk-[A-Za-z0-9_-]+"
IMAGE_URL = r"(?i)data\s*:\s*image/[A-Za-z0-9.+-]+(?:\s*;[^,]*)?\s*;\s*base64\s*,"
SECRET_FIELDS = ("api_key",)


@dataclass(frozen=True)
class Redaction:
    """What is secret: field and map key names (in any case, - as _), and texts that go wherever they occur."""

    fields: tuple[str, ...] = SECRET_FIELDS
    texts: tuple[str, ...] = ()

    def secret_name(self, name: str) -> bool:
        return name.casefold().replace("-", "_") in self.fields

    def secret_key(self, key: Column) -> Column:
        return F.replace(F.lower(key), F.lit("-"), F.lit("_")).isin(*self.fields)

    def text(self, value: Column) -> Column:
        """A text without tokens and secret texts; one with an image's data URL is replaced as a whole."""
        plain = value
        for secret in self.texts:
            plain = F.replace(plain, F.lit(secret), F.lit(MARK))
        return F.when(value.rlike(IMAGE_URL), IMAGE_MARK).otherwise(F.regexp_replace(plain, TOKEN, MARK))

    def value(self, value: Column, kind: DataType) -> Column:
        """A value of some type with everything secret in it replaced.

        What a secret name holds becomes MARK where it is text, and null where
        it has another type.  Equal keys of a map after redaction keep the last.
        """
        if isinstance(kind, StringType):
            return self.text(value)
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: self.value(x, kind.elementType))
        if isinstance(kind, MapType):
            return self._map(value, kind)
        if isinstance(kind, StructType):
            fields = [self._secret(f.dataType) if self.secret_name(f.name) else self.value(value.getField(f.name), f.dataType) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*[c.alias(f.name) for c, f in zip(fields, kind.fields, strict=True)]))
        return value

    @staticmethod
    def _secret(kind: DataType) -> Column:
        return F.lit(MARK) if isinstance(kind, StringType) else F.lit(None).cast(kind)

    def _map(self, value: Column, kind: MapType) -> Column:
        texts = isinstance(kind.keyType, StringType)
        rebuilt = lambda e: self.value(e["value"], kind.valueType)
        if not texts:
            return F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), rebuilt(e).alias("value"))))
        entries = F.transform(F.map_entries(value), lambda e: F.struct(self.text(e["key"]).alias("key"), F.when(self.secret_key(e["key"]), self._secret(kind.valueType)).otherwise(rebuilt(e)).alias("value")))
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
        return F.map_from_entries(last)


def redacted_frame(frame: DataFrame, rules: Redaction = Redaction()) -> DataFrame:
    """Every column of a frame redacted, by its own name as by those inside it."""
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    secret = lambda n: Redaction._secret(kinds[n])
    return frame.select(*[(secret(n) if rules.secret_name(n) else rules.value(F.col(f"`{n}`"), kinds[n])).alias(n) for n in frame.columns])

"""Civil registers: people on certificates, and the XML in which archives publish them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergekin.standardise import birth_year, clean_marriage_year, gender, parse_date, standard_string

#: People on each kind of certificate: column prefix, role, sex ('' if the row tells it), and relations as prefixes.
CERTIFICATES = {
    "birth": [("child", "Bb", "", {"mother": "mother", "father": "father"}), ("mother", "Bp", "F", {"child": "child", "spouse": "father"}), ("father", "Bp", "M", {"child": "child", "spouse": "mother"})],
    "marriage": [
        ("bride", "Mm", "F", {"mother": "bride_mother", "father": "bride_father", "spouse": "groom"}), ("groom", "Mm", "M", {"mother": "groom_mother", "father": "groom_father", "spouse": "bride"}),
        ("bride_mother", "Mbp", "F", {"child": "bride", "spouse": "bride_father"}), ("bride_father", "Mbp", "M", {"child": "bride", "spouse": "bride_mother"}),
        ("groom_mother", "Mgp", "F", {"child": "groom", "spouse": "groom_father"}), ("groom_father", "Mgp", "M", {"child": "groom", "spouse": "groom_mother"}),
    ],
    "death": [
        ("deceased", "Dd", "", {"mother": "mother", "father": "father", "spouse": "spouse"}), ("mother", "Dp", "F", {"child": "deceased", "spouse": "father"}),
        ("father", "Dp", "M", {"child": "deceased", "spouse": "mother"}), ("spouse", "Ds", "", {"spouse": "deceased"}),
    ],
}
_RELATIONS = ["mother", "father", "child", "spouse"]
_OPTIONAL = ["addr1", "addr2", "parish", "occ", "birth_place", "marriage_place1", "marriage_place2", "marital_status"]


def certificate_people(rows: DataFrame, kind: str) -> DataFrame:
    """One row per person of each certificate, in one pass: id, cert_id, role, sex, names, event date and year, places, years and related ids.

    rows: cert_id, event_date (text), and for each prefix of CERTIFICATES[kind] <prefix>_fname, <prefix>_sname and, where the source has them,
    <prefix>_gender, <prefix>_age, <prefix>_birth_year and the optional columns.  A person arises if either name is known; relations only
    point to people who do.  Ids are <cert_id>_<prefix>.
    """
    have = set(rows.columns)
    col = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    prefixes = [p for p, *_ in CERTIFICATES[kind]]
    there = lambda p: F.col(f"_there_{p}")
    id_of = lambda p: F.concat(F.col("cert_id").cast("string"), F.lit(f"_{p}"))
    flagged = rows.withColumns({f"_there_{p}": standard_string(col(f"{p}_fname")).isNotNull() | standard_string(col(f"{p}_sname")).isNotNull() for p in prefixes})
    # The exploded structs hold raw texts; they are standardised once, after the explode, which keeps the generated code small.
    people = []
    for prefix, role, sex, relations in CERTIFICATES[kind]:
        raw_sex = F.lit(sex) if sex else F.lit(None).cast("string") if prefix == "spouse" else col(f"{prefix}_gender").cast("string")
        fields = [
            id_of(prefix).alias("id"), F.lit(role).alias("role"), raw_sex.alias("sex"), (col("deceased_gender").cast("string") if prefix == "spouse" else F.lit(None).cast("string")).alias("partner_sex"),
            col(f"{prefix}_fname").cast("string").alias("fname"), col(f"{prefix}_sname").cast("string").alias("sname"), col(f"{prefix}_birth_year").cast("string").alias("birth_year"), col(f"{prefix}_age").cast("string").alias("age"),
            there(prefix).alias("there"), *[(col(f"{prefix}_{o}") if f"{prefix}_{o}" in have else col(o)).cast("string").alias(o) for o in _OPTIONAL],
            *[(F.when(there(relations[r]), id_of(relations[r])) if r in relations else F.lit(None).cast("string")).alias(r) for r in _RELATIONS],
        ]
        people.append(F.struct(*fields))
    each = flagged.select(F.col("cert_id").cast("string").alias("cert_id"), parse_date("event_date").alias("event_date"), col("marriage_year").cast("string").alias("marriage_year"), F.explode(F.array(*people)).alias("p"))
    each = each.select("cert_id", "event_date", F.year("event_date").alias("event_year"), F.unix_timestamp("event_date").alias("timestamp"), F.lit(kind).alias("kind"), "marriage_year", "p.*").where("there")
    partner = gender(F.col("partner_sex"))
    born = F.coalesce(F.col("birth_year").try_cast("int"), birth_year(F.col("event_year"), F.col("age")), F.when(F.col("role") == "Bb", F.col("event_year")))
    return each.select(
        "cert_id", "event_date", "event_year", "timestamp", "kind", "id", "role", F.coalesce(gender(F.col("sex")), F.when(partner == "M", "F").when(partner == "F", "M")).alias("sex"),
        standard_string("fname").alias("fname"), standard_string("sname").alias("sname"), born.alias("birth_year"), clean_marriage_year(F.col("marriage_year").try_cast("int")).alias("marriage_year"),
        *[standard_string(o).alias(o) for o in _OPTIONAL], *_RELATIONS,
    )


def relatives(people: DataFrame) -> DataFrame:
    """(record, relation, other) of certificate people."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("relation"), F.col(r).alias("other")) for r in _RELATIONS])).alias("x")
    return people.select(F.col("id").alias("record"), each).select("record", "x.relation", "x.other").where("other is not null")


# --- XML of archives ---------------------------------------------------------------------------------------------

#: Relation types of the archives' XML (Dutch) and the column prefix of the person in that relation.
XML_RELATIONS = {
    "birth": {"Kind": "child", "Moeder": "mother", "Vader": "father"},
    "marriage": {"Bruid": "bride", "Bruidegom": "groom", "Moeder van de bruid": "bride_mother", "Vader van de bruid": "bride_father", "Moeder van de bruidegom": "groom_mother", "Vader van de bruidegom": "groom_father"},
    "death": {"Overledene": "deceased", "Moeder": "mother", "Vader": "father", "Partner": "spouse"},
}
#: Sexes in that XML.
XML_GENDERS = {"Man": "m", "Vrouw": "f"}

XML_SCHEMA = """
    `a2a:Person` array<struct<_pid: string, `a2a:PersonName`: struct<`a2a:PersonNameFirstName`: string, `a2a:PersonNameLastName`: string>,
        `a2a:Gender`: string, `a2a:Age`: struct<`a2a:PersonAgeLiteral`: string>>>,
    `a2a:Event`: struct<_eid: string, `a2a:EventDate`: struct<`a2a:Year`: string, `a2a:Month`: string, `a2a:Day`: string>, `a2a:EventPlace`: struct<`a2a:Place`: string>>,
    `a2a:RelationEP` array<struct<`a2a:PersonKeyRef`: string, `a2a:RelationType`: string>>
""".replace("`a2a:Event`:", "`a2a:Event`")


def read_archive_xml(spark: SparkSession, path: str, tag: str = "a2a:A2A") -> DataFrame:
    """One row per record element, read with a fixed schema: files are split, not parsed as a whole."""
    return spark.read.format("xml").option("rowTag", tag).schema(XML_SCHEMA).load(path)


def xml_gender(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for text, code in XML_GENDERS.items():
        out = F.when(c == text, code).otherwise(out)
    return out


def archive_certificates(records: DataFrame, kind: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """The certificate rows of XML records: cert_id, event date and place, and name, sex and age of each person by relation.

    The relation list joins people to their part by person key within the record, so no shuffle is needed.
    """
    date = F.col("`a2a:Event`.`a2a:EventDate`")
    part = lambda f: date[f"a2a:{f}"]
    out = [
        F.col("`a2a:Event`._eid").alias("cert_id"), F.concat_ws("/", part("Day"), part("Month"), part("Year")).alias("event_date"), part("Year").try_cast("int").alias("event_year"),
        F.col("`a2a:Event`.`a2a:EventPlace`.`a2a:Place`").alias("event_place"),
    ]
    for relation, prefix in XML_RELATIONS[kind].items():
        ref = F.try_element_at(_with_type(relation), F.lit(1))["a2a:PersonKeyRef"]
        person = F.try_element_at(_with_key(ref), F.lit(1))
        name = person["a2a:PersonName"]
        out += [
            name["a2a:PersonNameFirstName"].alias(f"{prefix}_fname"), name["a2a:PersonNameLastName"].alias(f"{prefix}_sname"), xml_gender(person["a2a:Gender"]).alias(f"{prefix}_gender"),
            person["a2a:Age"]["a2a:PersonAgeLiteral"].alias(f"{prefix}_age"),
        ]
    rows = records.select(*out)
    if first_year is not None or last_year is not None:
        rows = rows.where(F.col("event_year").between(first_year or 0, last_year or 9999))
    return rows


def _with_type(relation: str) -> Column:
    return F.filter(F.col("`a2a:RelationEP`"), lambda r: r["a2a:RelationType"] == relation)


def _with_key(ref: Column) -> Column:
    return F.filter(F.col("`a2a:Person`"), lambda p: p["_pid"] == ref)


def xml_tags(records: DataFrame) -> list[str]:
    """Dotted names of all elements of a schema inferred or given."""

    def walk(t, prefix: str) -> list[str]:
        if hasattr(t, "fields"):
            return [x for f in t.fields for x in [f"{prefix}{f.name}", *walk(f.dataType, f"{prefix}{f.name}.")]]
        return walk(t.elementType, prefix) if hasattr(t, "elementType") else []

    return walk(records.schema, "")

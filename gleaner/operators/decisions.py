"""Checks of proposed categories against the existing ones, as joins over all proposals at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.tables import similar_names

# Category names of one word that stand, and marks of business content.
SINGLE_WORDS = ("documentation", "commands", "code", "notes", "links", "research", "news", "articles", "personal", "ideas", "shopping", "social")
BUSINESS_WORDS = (
    "case study", "success story", "partnership", "harnesses", "transformed", "discover", "company", "firm", "corporation", "business", "marketing", "product", "testimonial", "outcome", "value proposition", "sales",
)
BUSINESS_NAMES = ((("case study", "success story", "partnership"), "Business Case Studies"), (("marketing", "product"), "Business Marketing"), (("harnesses",), "Business Partnerships"), (("aec", "construction", "engineering"), "AEC Business Content"))
BUSINESS_OTHER = "Business Content"
# Similarity above which a name is reused, or repaired; confidences of each step.
REUSE, REPAIR = 0.85, 0.80
SAME, SIMILAR, INVENTED, REJECTED, FAMILY, FAMILY_OLD, FAMILY_NEW, MOST, DOUBT = 0.95, 0.90, 0.75, 0.85, 0.95, 0.88, 0.92, 0.95, 0.70


def bad_name(name: Column) -> Column:
    """Too short, an acronym, one word that doesn't stand alone, a code, or without a letter."""
    x = T.trim_all(name)
    n, letters = F.length(x), F.regexp_count(x, F.lit(r"\p{L}"))
    acronym = ~x.rlike(r"\p{Ll}") & n.between(2, 4)
    single = (F.size(T.words(x)) < 2) & ~F.lower(x).isin(*SINGLE_WORDS)
    code = x.rlike(r"^[\p{L}\p{N} -]*$") & (letters <= 3) & x.rlike(r"\p{N}")
    return (n < 3) | acronym | single | code | (letters == 0)


def business(content: Column, url: Column) -> Column:
    low, site = F.lower(content), F.lower(F.coalesce(url, F.lit("")))
    page = ((site.contains(".com") | site.contains(".ai")) & ~site.contains("docs.")) | T.has_any(site, ("company", "product", "business"))
    return T.has_any(low, BUSINESS_WORDS) | page


def _named(categories: DataFrame, rows: DataFrame, floor: float, prefix: str) -> DataFrame:
    found = similar_names(categories, rows.select("name").distinct(), floor)
    return rows.join(found.select("name", F.col("category").alias(f"{prefix}_name"), F.col("score").alias(f"{prefix}_score")), "name", "left")


def validate(proposals: DataFrame, categories: DataFrame) -> DataFrame:
    """id, action, name, confidence from proposals (id, action, name, confidence, content, type, url).

    Names lose emoji and become an existing category's where they are the same or
    much alike; bad names are replaced by one from the content; documentation is
    refused for business content (texts get a business name, others null); a use of
    what isn't there becomes a use of the most similar or a creation; commands of a
    known tool take its family.
    """
    key = lambda c: T.normalize_category(F.col(c))
    known = categories.select(F.col("name").alias("known"), key("name").alias("key"))
    rows = proposals.withColumn("name", T.without_emoji(F.col("name"))).withColumn("key", key("name")).join(known, "key", "left").drop("key")
    rows = _named(categories, rows, REUSE, "alike")
    like, same = F.col("alike_name").isNotNull(), F.col("known").isNotNull()
    rows = rows.select(
        "id", "content", "type", "url",
        F.when(same | like, "use_existing").when(bad_name(F.col("name")), "create_new").otherwise(F.col("action")).alias("action"),
        F.coalesce("known", "alike_name", F.when(bad_name(F.col("name")), T.fallback_category(F.col("content"), F.col("type"))), "name").alias("name"),
        F.when(same, SAME).when(like, SIMILAR).when(bad_name(F.col("name")), INVENTED).otherwise(F.col("confidence")).alias("confidence"),
    )
    refused = F.lower("name").contains("documentation") & business(F.col("content"), F.col("url"))
    instead = F.coalesce(*(F.when(T.has_any(F.lower("content"), words), name) for words, name in BUSINESS_NAMES), F.lit(BUSINESS_OTHER))
    rows = rows.withColumns({
        "name": F.when(refused, F.when(F.col("type") == "text", instead)).otherwise(F.col("name")),
        "action": F.when(refused, "create_new").otherwise(F.col("action")), "confidence": F.when(refused, REJECTED).otherwise(F.col("confidence")),
    })
    rows = rows.join(known.select(F.lower("known").alias("low"), F.lit(True).alias("there")).distinct(), F.lower("name") == F.col("low"), "left").drop("low")
    rows = _named(categories, rows, REPAIR, "near")
    missing, near = (F.col("action") == "use_existing") & F.col("there").isNull(), F.col("near_name").isNotNull()
    reuse = (F.col("action") == "create_new") & (F.col("near_score") > REUSE)
    rows = rows.withColumns({
        "confidence": F.when(missing & near, F.least(F.col("confidence") * F.col("near_score"), F.lit(MOST))).when(missing, F.col("confidence") * 0.9).when(reuse, F.least(F.col("confidence") * 0.9, F.lit(MOST))).otherwise(F.col("confidence")),
        "action": F.when((missing & near) | reuse, "use_existing").when(missing, "create_new").otherwise(F.col("action")),
        "name": F.when((missing & near) | reuse, F.col("near_name")).otherwise(F.col("name")),
    }).select("id", "content", "type", "action", "name", "confidence")
    families = rows.select("id", F.col("type").alias("kind"), T.command_family(F.col("content")).getField("name").alias("name")).where(F.col("name").isNotNull())
    families = _named(categories, families, REPAIR, "family").select("id", F.col("name").alias("family"), "family_name")
    rows = rows.join(families, "id", "left")
    command = F.col("type") == "command"
    taken = F.col("family").isNotNull() & (command | (F.col("confidence") < DOUBT))
    old = F.col("family_name").isNotNull()
    return rows.select(
        "id", F.when(taken, F.when(old, "use_existing").otherwise("create_new")).otherwise(F.col("action")).alias("action"), F.when(taken, F.coalesce("family_name", "family")).otherwise(F.col("name")).alias("name"),
        F.when(taken, F.when(command, FAMILY).when(old, FAMILY_OLD).otherwise(FAMILY_NEW)).otherwise(F.col("confidence")).alias("confidence"),
    )

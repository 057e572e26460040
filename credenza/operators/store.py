"""Store operators as pure functions (tables in, next tables out): plain Parquet has no MERGE, UPDATE or DELETE.

Every fold over changes takes an explicit order column, so results do not depend on partitioning; folds are
groupBy aggregates (combined before the shuffle) or equi-joins, never per-row loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credenza.functions import variants, text


#: Columns of the store's tables. Times are ISO-8601 text, as they are written.
SCHEMAS = {
    "audit_logs": "log_id bigint, created_at string, event_type string, subject_id string, status string, details string",
    "identity_verifications": "id bigint, created_at string, subject_id string, id_type string, id_number string, full_name string, nationality string, biometric_status string, document_status string, watchlist_status string, risk_score string, final_status string, source string",
    "verified_users": "unique_id string, full_name string, date_of_birth string, address string, created_at string, updated_at string, latest_risk_score int, status string, email string, password_hash string, email_verified int, mfa_enabled int",
    "password_reset_tokens": "id bigint, unique_id string, token_hash string, created_at string, expires_at string, used_at string",
    "auth_events": "id bigint, created_at string, email string, event_type string, success int, details string",
    "email_otps": "id bigint, email string, purpose string, otp_hash string, created_at string, expires_at string, used_at string",
    "identity_registry": "id bigint, id_type string, document_number_normalized string, unique_id string, full_name string, created_at string, updated_at string",
    "face_captures": "id bigint, unique_id string, captured_at string, original_filename string, stored_filename string, stored_path string, mime_type string, sha256 string, file_size bigint, source string, liveness_status string, motion_score double, motion_samples int",
    "user_documents": "id bigint, unique_id string, id_type string, document_number string, document_number_normalized string, full_name string, date_of_birth string, address string, risk_score int, final_status string, created_at string, verification_id bigint, details string, reverification_count int",
}
#: The key columns by which tables refer to a user.
USER_KEYS = {"identity_verifications": "subject_id", "user_documents": "unique_id", "identity_registry": "unique_id", "password_reset_tokens": "unique_id", "audit_logs": "subject_id", "verified_users": "unique_id"}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def append_event(table: DataFrame, events: DataFrame, details: list[str]) -> DataFrame:
    """Appends events whose details columns become one JSON text (null ones are left out)."""
    packed = F.to_json(F.struct(*[F.col(c) for c in details]))
    return append(table, events.withColumn("details", packed).select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns]))


def insert_users(users: DataFrame, new: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The next users, and the rows of new that are refused: an email (trimmed, in small letters) is used once, by the
    user that has it or the first of the new ones; users without an email are not compared."""
    key = text.absent(text.email(F.col("email")))
    taken = users.select(key.alias("__taken")).filter("__taken IS NOT NULL").distinct()
    keyed = new.withColumn("__email", key)
    first = keyed.filter("__email IS NOT NULL").groupBy(F.col("__email").alias("__same")).agg(F.min(F.struct(*order)).alias("__first"))
    judged = keyed.join(taken, F.col("__email") == F.col("__taken"), "left").join(first, F.col("__email") == F.col("__same"), "left")
    fresh = F.col("__email").isNull() | (F.col("__taken").isNull() & (F.struct(*order) == F.col("__first")))
    return append(users, judged.filter(fresh).select(*new.columns)), judged.filter(~fresh).select(*new.columns)


def migrate_user_ids(tables: dict[str, DataFrame], new_id: Column) -> dict[str, DataFrame]:
    """Users whose id is their own email get new_id (an expression over the user's row) in every table that names them."""
    users = tables["verified_users"]
    named = (F.trim("unique_id") == text.email(F.col("email"))) & text.absent(F.col("email")).isNotNull()
    mapping = users.filter(named).select(F.col("unique_id").alias("old_id"), new_id.alias("new_id"))
    return {name: rewrite_keys(table, mapping, USER_KEYS[name]) if name in USER_KEYS else table for name, table in tables.items()}


def guarded_upsert(table: DataFrame, changes: DataFrame, order: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """table and changes: number_key, owner and values. The next table, and each change's outcome (INSERT, UPDATE,
    REJECT_EMPTY, REJECT_OWNER), changes of one batch seeing those before them: a number belongs to its owner in the
    table or, if it is new, to the first change's; the last change of that owner stays."""
    usable = changes.filter(F.col("number_key") != "")
    first = usable.groupBy(F.col("number_key").alias("f_key")).agg(F.min_by(F.struct("owner", F.col(order).alias("at")), order).alias("first"))
    known = table.select(F.col("number_key").alias("t_key"), F.col("owner").alias("t_owner"))
    judged = changes.join(first, F.col("number_key") == F.col("f_key"), "left").join(known, F.col("number_key") == F.col("t_key"), "left")
    holder = F.coalesce("t_owner", "first.owner")
    outcome = F.when(F.col("f_key").isNull(), "REJECT_EMPTY").when(F.col("owner") != holder, "REJECT_OWNER").when(F.col("t_key").isNull() & (F.col(order) == F.col("first.at")), "INSERT").otherwise("UPDATE")
    outcomes = judged.withColumn("outcome", outcome).select(*changes.columns, "outcome")
    accepted = outcomes.filter(F.col("outcome").isin("INSERT", "UPDATE")).groupBy("number_key").agg(F.max_by(F.struct("owner", *values), order).alias("new"))
    both = table.join(accepted.withColumnRenamed("number_key", "a_key"), F.col("number_key") == F.col("a_key"), "full_outer")
    taken = [F.when(F.col("a_key").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ["owner", *values]]
    return both.select(F.coalesce("number_key", "a_key").alias("number_key"), *taken), outcomes


def audit_union(users: DataFrame, audit_logs: DataFrame, auth_events: DataFrame, event: str = "DOCUMENT_SCREENING", login: str = "LOGIN") -> DataFrame:
    """Every user's timeline: their screenings and, by email, their successful logins, newest first, with the user's
    own data put into the details (details that are no JSON object are replaced)."""
    user = users.select(F.col("unique_id").alias("u_id"), F.col("email").alias("u_email"), F.to_json(F.struct(F.col("unique_id").alias("uniqueId"), "email", F.col("full_name").alias("fullName"), (F.coalesce("email_verified", F.lit(0)) != 0).alias("emailVerified"), "status"), {"ignoreNullFields": "false"}).alias("user"))
    screened = audit_logs.filter(F.col("event_type") == event).join(user, F.col("subject_id") == F.col("u_id")).select("log_id", "created_at", "event_type", "subject_id", "status", "details", F.lit("AUDIT").alias("log_source"), "user", F.col("u_id").alias("owner"))
    logged = auth_events.filter((F.col("event_type") == login) & (F.col("success") == 1)).join(user, F.col("email") == F.col("u_email")).select(F.col("id").alias("log_id"), "created_at", "event_type", F.col("email").alias("subject_id"), F.lit("SUCCESS").alias("status"), "details", F.lit("AUTH").alias("log_source"), "user", F.col("u_id").alias("owner"))
    out = screened.unionByName(logged).withColumn("details", variants.with_entry(F.col("details"), "user", F.col("user"))).drop("user")
    return out.orderBy(F.desc("created_at"), F.desc("log_id"), "log_source")


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Union by name; columns that one side lacks are null (additive schema evolution)."""
    return table.unionByName(rows, allowMissingColumns=True)


def with_defaults(table: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns a table of an older schema lacks, with their defaults."""
    return table.withColumns({name: value for name, value in defaults.items() if name not in table.columns})


def patch(table: DataFrame, changes: DataFrame, key: str, keep_if_blank: list[str], keep_if_null: list[str]) -> DataFrame:
    """Left join of changes: blank new values keep the old ones in keep_if_blank, null ones in keep_if_null."""
    new = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in keep_if_blank + keep_if_null])
    joined = table.join(new, F.col(key) == F.col("__key"), "left")
    values = {c: F.coalesce(text.absent(F.col(f"__{c}")), F.col(c)) for c in keep_if_blank} | {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in keep_if_null}
    return joined.withColumns(values).select(*table.columns)


def registry_upsert(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Fold of a number's registrations: the last owner and time, the last name that is given, the first type and time."""
    at = F.struct(*order)
    return events.groupBy(key).agg(
        F.max_by("owner", at).alias("owner"),
        F.max_by(F.col("full_name"), F.when(F.col("full_name").isNotNull(), at)).alias("full_name"),
        F.min_by("id_type", at).alias("id_type"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
    )


def guarded_upsert_actions(table: DataFrame, changes: DataFrame) -> DataFrame:
    """What each change (number_key, owner, change_id) does to a table keyed by number_key: INSERT, UPDATE, REJECT_EMPTY or REJECT_OWNER."""
    current = table.select(F.col("number_key").alias("t_key"), F.col("owner").alias("t_owner"), F.col("id").alias("t_id"))
    joined = changes.join(current, F.col("number_key") == F.col("t_key"), "left")
    action = F.when(F.col("number_key") == "", "REJECT_EMPTY").when(F.col("t_key").isNull(), "INSERT").when(F.col("t_owner") != F.col("owner"), "REJECT_OWNER").otherwise("UPDATE")
    return joined.select("change_id", "number_key", "owner", F.col("t_id").alias("kept_id"), action.alias("action"))


def count_up(table: DataFrame, changes: DataFrame, key: str, counter: str) -> DataFrame:
    """Adds the number of changes per key to the counter; null counts as 0."""
    n = changes.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    return table.join(n, F.col(key) == F.col("__key"), "left").withColumn(counter, F.coalesce(F.col(counter), F.lit(0)) + F.coalesce("__n", F.lit(0))).select(*table.columns)


def consume_once(table: DataFrame, used: DataFrame, key: str, at: str) -> DataFrame:
    """Sets used_at from the first use where it is null."""
    first = used.groupBy(F.col(key).alias("__key")).agg(F.min(at).alias("__at"))
    return table.join(first, F.col(key) == F.col("__key"), "left").withColumn("used_at", F.coalesce("used_at", "__at")).select(*table.columns)


def replace_pending(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Drops unused rows of the keys that new rows name, then appends the new rows."""
    named = new.select(*keys).distinct()
    pending, done = table.filter("used_at IS NULL"), table.filter("used_at IS NOT NULL")
    return pending.join(named, keys, "left_anti").select(*table.columns).unionByName(done).unionByName(new)


def cascade_delete(documents: DataFrame, registry: DataFrame, verifications: DataFrame, request: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deletes documents by (id, owner), then registry rows by (type, number) whoever owns them, then
    verifications by (id, owner of the deleted document)."""
    gone = documents.join(request, ["id", "owner"], "left_semi")
    kept = documents.join(request, ["id", "owner"], "left_anti")
    registry_left = registry.join(gone.select("id_type", "number_key").distinct(), ["id_type", "number_key"], "left_anti")
    verifications_left = verifications.join(gone.select(F.col("verification_id"), "owner").distinct(), ["verification_id", "owner"], "left_anti")
    return kept, registry_left, verifications_left


def drop_children(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return child.join(gone.select(key).distinct(), key, "left_anti")


def rewrite_keys(table: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Replaces old keys by new ones where the mapping (old_id, new_id) has them."""
    return table.join(mapping, F.col(key) == F.col("old_id"), "left").withColumn(key, F.coalesce("new_id", key)).select(*table.columns)


def free_ids(candidates: DataFrame, taken: DataFrame, key: str, n: int) -> DataFrame:
    """The n least candidates that are not taken."""
    return candidates.join(taken.select(key), key, "left_anti").orderBy(key).limit(n)


def latest(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order."""
    return table.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def full_outer_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """ADDED, REMOVED, MATCH or CHANGED per key, b against a."""
    left, right = a.select(*keys, F.col(value).alias("old_value")), b.select(*keys, F.col(value).alias("new_value"))
    status = F.when(F.col("old_value").isNull(), "ADDED").when(F.col("new_value").isNull(), "REMOVED").when(F.col("old_value") == F.col("new_value"), "MATCH").otherwise("CHANGED")
    return left.join(right, keys, "full_outer").withColumn("status", status)


def override_by_confidence(generic: DataFrame, special: DataFrame, keys: list[str], least: Column) -> DataFrame:
    """The specialised value where it is confident enough or the generic one is absent; conflict where they differ."""
    g, s = generic.select(*keys, F.col("value").alias("g_value")), special.select(*keys, F.col("value").alias("s_value"), F.col("conf").alias("s_conf"))
    joined = g.join(s, keys, "full_outer")
    take = F.col("s_value").isNotNull() & (F.col("g_value").isNull() | (F.col("s_conf") >= least))
    return joined.select(*keys, F.when(take, F.col("s_value")).otherwise(F.col("g_value")).alias("value"), F.coalesce(F.lower("g_value") != F.lower("s_value"), F.lit(False)).alias("conflict"))

"""Which configuration values may be shown, and why not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.paths import relative_value

# Names whose value may be shown.
DISCLOSABLE_NAMES = """
ABSPATH ADMIN_COOKIE_PATH AUTOMATIC_UPDATER_DISABLED AUTOSAVE_INTERVAL BLOG_ID_CURRENT_SITE
COMPRESS_CSS COMPRESS_SCRIPTS CONCATENATE_SCRIPTS COOKIE_DOMAIN COOKIEPATH DB_CHARSET DB_COLLATE
DB_HOST DB_NAME DB_USER DISABLE_WP_CRON DISALLOW_FILE_EDIT DISALLOW_FILE_MODS DOMAIN_CURRENT_SITE
EMPTY_TRASH_DAYS FORCE_SSL_ADMIN FORCE_SSL_LOGIN FS_METHOD IMAGE_EDIT_OVERWRITE MEDIA_TRASH MULTISITE
NOBLOGREDIRECT PATH_CURRENT_SITE PLUGINS_COOKIE_PATH RELOCATE SAVEQUERIES SCRIPT_DEBUG
SITE_ID_CURRENT_SITE SITECOOKIEPATH STYLESHEETPATH SUBDOMAIN_INSTALL TEMPLATEPATH UPLOADS
WP_ACCESSIBLE_HOSTS WP_ALLOW_MULTISITE WP_AUTO_UPDATE_CORE WP_CACHE WP_CONTENT_DIR WP_CONTENT_URL
WP_CRON_LOCK_TIMEOUT WP_DEBUG WP_DEBUG_DISPLAY WP_DEBUG_LOG WP_DEFAULT_THEME WP_ENVIRONMENT_TYPE
WP_HOME WP_LANG_DIR WP_MAX_MEMORY_LIMIT WP_MEMORY_LIMIT WP_PLUGIN_DIR WP_PLUGIN_URL
WP_POST_REVISIONS WP_PROXY_HOST WP_PROXY_PORT WP_SITEURL WP_TEMP_DIR WPLANG
""".split()
# Parts of a name that mark it as a secret, in any case.
SECRET_PARTS = "API AUTH CREDENTIAL KEY LICEN NONCE PASS PRIVATE SALT SECRET TOKEN".split()
# The reasons a record carries.
INCLUDED, NOT_ALLOW_LISTED, SECRET = "included", "not_allow_listed", "secret"
# Fixed value: how a definition is written in source text. The boundary is an ASCII one.
DEFINE_PATTERN = r"""(?<![A-Za-z0-9_])define\s*\(\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]"""


def disclosure(name: Column, extra: Sequence[str] = ()) -> Column:
    """Reason for one name; the secret check also overrules the allow-list."""
    secret = name.rlike("(?i)" + "|".join(SECRET_PARTS))
    allowed = name.isin(*DISCLOSABLE_NAMES, *extra)
    return F.when(secret, SECRET).when(allowed, INCLUDED).otherwise(NOT_ALLOW_LISTED)


def define_records(df: DataFrame, root: Column, extra: Sequence[str] = ()) -> DataFrame:
    """Adds ``disclosure`` to (name, value) rows and withholds every value not included."""
    reason = disclosure(F.col("name"), extra)
    shown = F.when(F.col("disclosure") == INCLUDED, relative_value(F.col("value"), root))
    return df.withColumn("disclosure", reason).withColumn("value", shown)


def define_names(source: Column) -> Column:
    """Names defined in a source text, each once, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(DEFINE_PATTERN), F.lit(1)))

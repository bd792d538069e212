"""Values that results depend on: entity types, labels, word lists and limits."""

# Entity types with the name a label shows and the name a list shows.
TYPES = {
    "PERSON": ("Person", "People"),
    "ADDRESS": ("Address", "Addresses and postcodes"),
    "PLACE": ("Place", "Places"),
    "ORGANISATION": ("Organisation", "Organisations and services"),
    "PHONE": ("Phone number", "Phone numbers"),
    "EMAIL": ("Email", "Email addresses"),
    "ID": ("ID number", "ID and reference numbers"),
    "DATE_OF_BIRTH": ("Date of birth", "Dates of birth"),
    "OTHER": ("Detail", "Other identifying details"),
}

# Titles before a name.
TITLES = "mr mrs ms miss mx dr prof professor nurse sister rev reverend sir lady lord cllr councillor auntie aunty uncle nan nanna grandma grandad".split()

# Family words that stand for a name and identify nobody.
FAMILY_WORDS = "mum mam mom mother dad father nan nana nanna gran granny grandma grandad grandpa nain taid mamgu tadcu auntie aunty uncle".split()

# Capitalised words that are no part of a name.
NOT_NAMES = "the and care plan mum dad son daughter wife husband brother sister monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split()

# Lower-case words inside names.
PARTICLES = "ap ab de van von der la le du da di bin al".split()

# Words inside identifying strings that identify nobody alone.
GENERIC = "street road place terrace close lane avenue high the and of care home hospital ward medical practice surgery residential inn flat room church school dr mr mrs ms nurse university sant y st".split()

# White space as the matcher sees it, as the inside of a character class.
SPACE = r"\t\n\x0B\f\r\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

# Limits of a document's terms, chunks and files.
MAX_TERMS, MAX_TERM, MAX_CHUNK = 500, 200, 12_000
MAX_FILE, MAX_PAGES, MAX_ENTRIES, MAX_UNPACKED = 20 * 1024 * 1024, 50, 3000, 100 * 1024 * 1024
REDACTED = "[Redacted]"

# Requests of a connection an hour and a day, and all pages a day.
PER_HOUR, PER_DAY, DAY_PAGES = 15, 40, 3000

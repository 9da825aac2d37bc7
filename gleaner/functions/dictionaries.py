"""Word lists, patterns and weights.

Everything in this module is a fixed value: results are defined in terms of these lists,
and where the first match counts, their order matters too.
"""

from __future__ import annotations

#: Fixed values. Where files usually belong: (pattern, score), first match in the lower-cased path.
CANONICAL = (
    ("/home/", 20), ("/pictures/", 20), ("/documents/", 10), ("/music/", 10), ("/videos/", 15), ("/desktop/", 5),
    ("/downloads/", -10), ("/users/", 20), ("/movies/", 15), ("photoslibrary/originals/", 20),
    ("photos library.photoslibrary/originals/", 20), ("users/", 20), ("dcim/", 20), ("100canon/", 20), ("100nikon/", 20),
    ("100msdcf/", 20), ("camera roll", 10), ("camera/", 10), ("/photos/", 15), ("/fotos/", 15), ("/imagenes/", 15),
    ("/projects/", 20), ("/data/", 10), ("/srv/", 10), ("/opt/", 10), ("/volumes/", 5),
)

#: Fixed values. How often a pattern stands in that list when the lists of all systems are put together, where that is not
#: once: no matter where the first match counts, but for sums over all of them it is.
CANONICAL_TIMES = {"/pictures/": 3, "/documents/": 2, "/music/": 3, "/videos/": 2, "/desktop/": 3, "/downloads/": 3}

#: Fixed values. Where files end up: (pattern, score), first match in the lower-cased path.
JUNK = (
    ("/tmp/", -100), ("/var/tmp/", -100), ("/temp/", -100), ("/cache/", -80), ("whatsapp/", -80), ("telegram/", -80),
    ("/downloads/", -70), ("/descargas/", -70), ("/trash/", -80), ("/.trash/", -80), ("/papelera/", -80), ("$recycle.bin", -80),
    ("/desktop/", -30), ("/escritorio/", -30), ("/screenshots/", -30), ("/capturas/", -30), ("node_modules/", -50),
    ("__pycache__/", -50), (".venv/", -50), ("/target/", -50), ("/build/", -50), ("tmp", -80), ("temp", -80), ("temporary", -80),
    ("cache", -80), ("backup", -80), ("backups", -80), ("respaldo", -80), ("respaldos", -80), ("recuperado", -80),
    ("recovered", -80), ("usb_recuperado", -80), ("viejo", -80), ("old", -80), ("old_downloads", -80), ("descargas_viejas", -80),
    ("old downloads", -80), ("nueva carpeta", -80), ("new folder", -80), ("carpeta_sin_nombre", -80), ("untitled folder", -80),
    ("pendiente", -80), ("pendientes", -80), ("por_revisar", -80), ("sin clasificar", -80), ("archivos_sin_clasificar", -80),
    ("unclassified", -80), ("coleccion_random", -80), ("coleccion_x", -80), ("misc", -80), ("varios", -80), ("random", -80),
    ("dump", -80), ("lost+found", -80), (".trash/", -50), (".fseventsd/", -50), (".spotlight-v100/", -50), ("%temp%", -50),
)

#: Fixed values. System files: names equal to, or starting with, one of these ...
SYSTEM_NAMES = (
    ".DS_Store", "._", "Icon\r", ".localized", "Thumbs.db", "desktop.ini", ".nomedia", "lost+found", "._*", "thumbcache_*.db",
)
#: ... or paths that hold one of these.
SYSTEM_PATHS = ("__MACOSX", ".git", ".svn", ".hg", ".bzr", "__MACOSX/", ".AppleDouble/", ".git/", ".hg/", ".svn/", ".bzr/")

#: Fixed values. Never scanned.
PROTECTED_PATHS = (
    "/bin", "/sbin", "/usr/bin", "/usr/sbin", "/usr/lib", "/usr/lib64", "/lib", "/lib64", "/boot", "/etc", "/proc", "/sys",
    "/dev", "/run", "/var/lib", "/var/cache", "/snap", "/flatpak", "/lost+found",
)
DEFAULT_EXCLUDES = ("/proc", "/sys", "/dev", "/run", "/tmp")

#: Fixed values. Marks of copies in file names.
COPY_MARKS = (
    "copy", "copia", "kopie", "コピー", "duplicate", "duplicado", "draft", "borrador", "backup", "respaldo", "old", "viejo",
    "ancien", "new", "nuevo", "nouveau", "final", "definitivo", "edit", "edited", "editado", "untitled", "sin_titulo",
    "sin título", "tmp", "temp", "v2", "v3", "v4",
)
DERIVED_EXTENSIONS = ("thm", "aae", "xmp", "tmp", "bak", "pp3", "on1", "cos")

#: Fixed values. Kinds of files by extension.
CATEGORIES = (
    ("Images", ("jpg", "jpeg", "png", "gif", "webp", "heic", "heif", "raw", "cr2", "nef", "dng", "tiff", "tif", "bmp", "ico")),
    ("Videos", ("mp4", "mov", "avi", "mkv", "webm", "m4v", "wmv", "flv")),
    ("Documents", ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "md", "rtf", "odt", "epub", "csv", "json", "xml", "html")),
    ("Audio", ("mp3", "flac", "wav", "m4a", "ogg", "opus", "aac", "wma", "aiff")),
    ("Archives", ("zip", "tar", "gz", "bz2", "7z", "rar", "xz", "zst", "lz4")),
)

#: Fixed values. Files that similarity looks at, and raw ones.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif", "ico")
RAW_SIBLINGS = ("cr2", "nef", "arw", "dng", "cr3")

#: Fixed values. System binaries and where they live.
SYSTEM_EXTENSIONS = ("exe", "dll", "sys", "drv", "ocx", "msi", "so", "ko", "a", "dylib", "bundle", "kext", "app", "wasm")
WINDOWS_DIRS = ("/windows/", "/program files/", "/program files (x86)/")
UNIX_DIRS = ("/system/", "/library/", "/usr/lib", "/usr/bin", "/usr/sbin", "/bin/", "/sbin/", "/boot/", "/lib/", "/lib64/")
PASSING_DIRS = ("/downloads/", "/descargas/", "/tmp/", "/var/tmp/")

#: Fixed values. Hygiene.
TEMPORARY_EXTENSIONS = ("tmp", "temp", "bak", "swp", "swo", "swn", "part", "crdownload", "partial")
SWAP_EXTENSIONS = ("swp", "swo", "swn")
CACHE_DIRS = ("__pycache__", ".venv", "target", "build")
LOCK_FILES = ("package.json", "pnpm-lock.yaml", "yarn.lock", "package-lock.json")
SIDECARS = (
    (".AAE", "companion HEIC was deleted", ("HEIC", "heic")),
    (".xmp", "companion RAW file was deleted", ("CR2", "NEF", "ARW", "DNG", "CR3", "cr2", "nef", "arw", "dng", "cr3")),
    (".thm", "companion media file was deleted", ("CR2", "NEF", "JPG", "MP4", "cr2", "nef", "jpg", "mp4")),
)
TAKEOUT_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "mp4", "mov", "heic", "tiff", "webp")

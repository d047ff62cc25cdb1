"""Fixed values that results depend on."""

# Extensions by category; any other extension is "Other".
CATEGORIES = {
    "Document": "pdf doc dot docx odt rtf txt md tex pages indd",
    "Spreadsheet": "xls xlsx ods csv numbers tsv",
    "Presentation": "ppt pptx odp key",
    "Image": "jpg jpeg png gif bmp svg webp tiff tif ico heic heif raw cr2 nef psd ai eps",
    "Video": "mp4 mov avi mkv wmv flv webm m4v",
    "Audio": "mp3 wav wave flac aac ogg oga opus wma m4a aiff aif",
    "Archive": "zip rar 7z tar gz bz2 xz dmg",
    "Code": "js ts py java c cpp h cs rb go rs php swift kt html css json xml yaml yml sh sql",
    "Font": "ttf otf woff woff2 eot",
    "Executable": "exe msi app deb rpm",
}

# MIME types of archive members; any other is application/octet-stream.
MEMBER_MIME = {
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
    "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp",
    "mp4": "video/mp4", "mp3": "audio/mpeg", "wav": "audio/wav", "txt": "text/plain",
    "html": "text/html", "css": "text/css", "js": "text/javascript", "json": "application/json",
    "xml": "application/xml", "csv": "text/csv", "zip": "application/zip",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}

# Detected types as extension: (MIME type, category).
DETECTED = {
    "pdf": ("application/pdf", "Document"), "doc": ("application/msword", "Document"),
    "zip": ("application/zip", "Archive"), "jpg": ("image/jpeg", "Image"), "png": ("image/png", "Image"),
    "gif": ("image/gif", "Image"), "tiff": ("image/tiff", "Image"),
    "psd": ("image/vnd.adobe.photoshop", "Image"), "heic": ("image/heic", "Image"),
    "mp4": ("video/mp4", "Video"), "bmp": ("image/bmp", "Image"), "webp": ("image/webp", "Image"),
    "wav": ("audio/wav", "Audio"), "aiff": ("audio/aiff", "Audio"), "flac": ("audio/flac", "Audio"),
    "ogg": ("audio/ogg", "Audio"), "mp3": ("audio/mpeg", "Audio"), "rtf": ("application/rtf", "Document"),
    "txt": ("text/plain", "Document"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "Document"),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "Spreadsheet"),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "Presentation"),
    "odt": ("application/vnd.oasis.opendocument.text", "Document"),
    "ods": ("application/vnd.oasis.opendocument.spreadsheet", "Spreadsheet"),
    "odp": ("application/vnd.oasis.opendocument.presentation", "Presentation"),
}

# Extensions with a view or an unpack action, and those that hold plain text.
VIEWABLE = "pdf ai doc dot docx rtf xlsx xls ods mp3 wav wave flac ogg oga aif aiff m4a aac opus mp4 mov m4v webm jpg jpeg png gif webp svg bmp ico tiff tif txt csv json xml html css js ts md log ini cfg yaml yml toml sh bat py rb java c cpp h rs go php sql".split()
ARCHIVES = "zip gz tar 7z rar bz2 xz".split()

# Export fields in order, and their labels.
FIELDS = {
    "referenceCode": "Reference Code", "name": "Name", "path": "Path", "category": "Category",
    "extension": "Extension", "type": "MIME Type", "sizeRaw": "Size (bytes)", "sizeFormatted": "Size",
    "lastModified": "Last Modified", "createdDate": "Created", "author": "Author", "title": "Title",
    "description": "Description", "levelOfDescription": "Level", "language": "Language",
    "extent": "Extent", "source": "Source", "url": "URL", "notes": "Notes", "excerpt": "Excerpt",
    "deepMeta": "Deep Metadata",
}

# Limits.
EXCERPT_CAP = 102_400  # bytes of plain text, else UTF-16 units
CACHE_CAP = 524_288_000  # bytes kept in the file cache
PAGE_ROWS = 50
PREVIEW = 200
TRUNCATED = "\n[…truncated]"

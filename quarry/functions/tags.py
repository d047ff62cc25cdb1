"""Keys of tagged metadata, by the container's own codes."""

ID3_FRAMES = {
    "TIT2": "title", "TPE1": "artist", "TALB": "album", "TRCK": "track", "TYER": "year", "TDRC": "year", "TCON": "genre",
    "TCOM": "composer", "TPE2": "albumArtist", "TPOS": "discNumber", "TBPM": "bpm", "TPUB": "publisher", "TCOP": "copyright",
    "TENC": "encodedBy", "TSSE": "encoderSettings", "TLAN": "language", "TKEY": "initialKey", "TSRC": "isrc", "TPE3": "conductor",
    "TEXT": "lyricist", "TOPE": "originalArtist", "TOAL": "originalAlbum", "TDOR": "originalReleaseDate", "COMM": "comment", "USLT": "lyrics",
}
VORBIS = {
    "encoder": "encoder", "title": "title", "artist": "artist", "album": "album", "date": "year", "tracknumber": "track", "genre": "genre",
    "comment": "comment", "albumartist": "albumArtist", "composer": "composer", "performer": "performer", "discnumber": "discNumber",
    "bpm": "bpm", "copyright": "copyright", "license": "license", "organization": "organization", "description": "description",
    "location": "location", "contact": "contact", "isrc": "isrc", "lyrics": "lyrics", "conductor": "conductor",
    "replaygain_track_gain": "replayGainTrack", "replaygain_album_gain": "replayGainAlbum",
}
RIFF_INFO = {
    "IART": "artist", "INAM": "title", "IPRD": "album", "ICRD": "year", "IGNR": "genre", "ICMT": "comment", "ISFT": "software",
    "IENG": "engineer", "ITCH": "technician", "ICOP": "copyright", "ISBJ": "subject", "ISRC": "source",
}
SUMMARY = {
    2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments", 7: "template", 8: "lastAuthor", 9: "revisionNumber", 10: "editTime",
    11: "lastPrinted", 12: "created", 13: "modified", 14: "pageCount", 15: "wordCount", 16: "charCount", 18: "application", 19: "security",
}
DOCUMENT_SUMMARY = {
    2: "category", 3: "presentationTarget", 4: "byteCount", 5: "lineCount", 6: "manager", 7: "company", 8: "paragraphCount", 9: "slideCount",
    10: "noteCount", 11: "hiddenSlideCount", 14: "docVersion", 26: "contentType", 27: "contentStatus", 28: "language",
}
IPTC = {5: "IptcTitle", 25: "IptcKeywords", 55: "IptcDateCreated", 80: "IptcAuthor", 116: "IptcCopyright", 120: "IptcDescription"}
EXIF = {
    0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation",
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x011A: "XResolution",
    0x011B: "YResolution", 0x011C: "PlanarConfiguration", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist",
    0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities", 0x0211: "YCbCrCoefficients", 0x0212: "YCbCrSubSampling", 0x0213: "YCbCrPositioning",
    0x0214: "ReferenceBlackWhite", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram",
    0x8824: "SpectralSensitivity", 0x8827: "ISO", 0x8828: "OECF", 0x8830: "SensitivityType", 0x8831: "StandardOutputSensitivity",
    0x8832: "RecommendedExposureIndex", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime",
    0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized", 0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel",
    0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue", 0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue",
    0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x9214: "SubjectArea",
    0x9286: "UserComment", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal", 0x9292: "SubSecTimeDigitized", 0xA000: "FlashpixVersion",
    0xA001: "ColorSpace", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA004: "RelatedSoundFile", 0xA20B: "FlashEnergy",
    0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit", 0xA214: "SubjectLocation",
    0xA215: "ExposureIndex", 0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType", 0xA302: "CFAPattern", 0xA401: "CustomRendered",
    0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType",
    0xA407: "GainControl", 0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness", 0xA40B: "DeviceSettingDescription",
    0xA40C: "SubjectDistanceRange", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA432: "LensSpecification",
    0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber", 0xA500: "Gamma",
}
BRANDS = {"isom": "MP4", "iso2": "MP4", "mp41": "MP4", "mp42": "MP4", "avc1": "MP4", "M4VH": "M4V", "M4VP": "M4V", "MSNV": "MP4", "mp71": "MP4"}
#: Bit rates in kbps by (MPEG version, layer), version 2 standing for 2.5 as well; the place is the header's index.
MPEG_RATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
#: Genres by their number in ID3v1 and its extensions.
GENRES = """
Blues|Classic Rock|Country|Dance|Disco|Funk|Grunge|Hip-Hop|Jazz|Metal|New Age|Oldies|Other|Pop|R&B|Rap|Reggae|Rock|Techno|Industrial
Alternative|Ska|Death Metal|Pranks|Soundtrack|Euro-Techno|Ambient|Trip-Hop|Vocal|Jazz+Funk|Fusion|Trance|Classical|Instrumental|Acid|House|Game|Sound Clip|Gospel|Noise
AlternRock|Bass|Soul|Punk|Space|Meditative|Instrumental Pop|Instrumental Rock|Ethnic|Gothic|Darkwave|Techno-Industrial|Electronic|Pop-Folk|Eurodance|Dream|Southern Rock|Comedy|Cult|Gangsta
Top 40|Christian Rap|Pop/Funk|Jungle|Native American|Cabaret|New Wave|Psychedelic|Rave|Showtunes|Trailer|Lo-Fi|Tribal|Acid Punk|Acid Jazz|Polka|Retro|Musical|Rock & Roll|Hard Rock
Folk|Folk-Rock|National Folk|Swing|Fast Fusion|Bebop|Latin|Revival|Celtic|Bluegrass|Avantgarde|Gothic Rock|Progressive Rock|Psychedelic Rock|Symphonic Rock|Slow Rock|Big Band|Chorus|Easy Listening|Acoustic
Humour|Speech|Chanson|Opera|Chamber Music|Sonata|Symphony|Booty Bass|Primus|Porn Groove|Satire|Slow Jam|Club|Tango|Samba|Folklore|Ballad|Power Ballad|Rhythmic Soul|Freestyle
Duet|Punk Rock|Drum Solo|A capella|Euro-House|Dance Hall|Goa|Drum & Bass|Club-House|Hardcore Techno|Terror|Indie|BritPop|Negerpunk|Polsk Punk|Beat|Christian Gangsta Rap|Heavy Metal|Black Metal|Crossover
Contemporary Christian|Christian Rock|Merengue|Salsa|Thrash Metal|Anime|JPop|Synthpop|Abstract|Art Rock|Baroque|Bhangra|Big Beat|Breakbeat|Chillout|Downtempo|Dub|EBM|Eclectic|Electro
Electroclash|Emo|Experimental|Garage|Global|IDM|Illbient|Industro-Goth|Jam Band|Krautrock|Leftfield|Lounge|Math Rock|New Romantic|Nu-Breakz|Post-Punk|Post-Rock|Psytrance|Shoegaze|Space Rock
Trop Rock|World Music|Neoclassical|Audiobook|Audio Theatre|Neue Deutsche Welle|Podcast|Indie Rock|G-Funk|Dubstep|Garage Rock|Psybient
""".strip().replace("\n", "|").split("|")

"""Column expressions F1-F20, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pts_seconds(ticks, timescale) -> Column:
    """Seconds of a tick count; 0 where the timescale is 0."""
    t = _c(timescale)
    return F.when(t == 0, F.lit(0.0)).otherwise(_c(ticks).cast("double") / F.nullif(t, F.lit(0)))


def segment_seconds(start, end, timescale) -> Column:
    """A segment's length in seconds, never below 0."""
    return F.greatest(F.lit(0.0), pts_seconds(end, timescale) - pts_seconds(start, timescale))


_ISO = r"^(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def iso_duration(text) -> Column:
    """Microseconds of an ISO-8601 duration (a year 365 days, a month 30); invalid or null: 0."""
    s = F.trim(_c(text))
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(s, _ISO, i), F.lit("")).cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))
    seconds = part(2) * 31536000 + part(3) * 2592000 + part(4) * 86400 + part(5) * 3600 + part(6) * 60 + part(7)
    micros = (seconds * 1000000).cast("bigint") * F.when(F.regexp_extract(s, _ISO, 1) == "-", -1).otherwise(1)
    return F.coalesce(F.when(s.rlike(_ISO) & s.rlike(r"\d"), micros), F.lit(0).cast("bigint"))


def media_type(mime, content_type) -> Column:
    """contentType where it is one of the three kinds, else what the mime type starts with, else unknown."""
    kind, m = _c(content_type), F.coalesce(_c(mime), F.lit(""))
    known = ["video", "audio", "text"]
    by_mime = F.when(m.startswith("video/"), "video").when(m.startswith("audio/"), "audio").when(m.startswith("text/"), "text").otherwise("unknown")
    return F.when(kind.isin(known), kind).otherwise(by_mime)


def _expand_uint(text: Column, name: str, value: Column) -> Column:
    """The first $name$ or $name%0Nd$ only."""
    pattern = rf"\${name}(%0(\d+)d)?\$"
    width = F.regexp_extract(text, pattern, 2)
    number = F.when(width == "", value.cast("string")).otherwise(F.when(F.length(value.cast("string")) >= width.cast("int"), value.cast("string")).otherwise(F.lpad(value.cast("string"), width.cast("int"), F.lit("0"))))
    found = F.regexp_extract(text, pattern, 0)
    at = F.instr(text, found)
    return F.when(found == "", text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), number, F.substring(text, at + F.length(found), F.length(text))))


def expand_template(template, number, time, rep) -> Column:
    """$RepresentationID$ everywhere, then the first $Number..$ and the first $Time..$."""
    t = F.replace(_c(template), F.lit("$RepresentationID$"), _c(rep))
    return _expand_uint(_expand_uint(t, "Number", _c(number)), "Time", _c(time))


def is_absolute(url) -> Column:
    return _c(url).startswith("http://") | _c(url).startswith("https://")


def join_base(base, path) -> Column:
    """A base chain's next link: an absolute URL replaces the base, an empty one keeps it, others are appended."""
    b, p = F.coalesce(_c(base), F.lit("")), F.coalesce(_c(path), F.lit(""))
    return F.when(p == "", b).when(is_absolute(p) | (b == ""), p).otherwise(F.concat(F.rtrim(b, F.lit("/")), F.lit("/"), F.ltrim(p, F.lit("/"))))


def resolve_base(base, path) -> Column:
    """Where the manifest itself lives after a hop, without trailing slashes."""
    b, p = F.coalesce(_c(base), F.lit("")), F.coalesce(_c(path), F.lit(""))
    joined = F.when(p == "", b).when(is_absolute(p), p)
    return F.when(joined.isNotNull(), F.rtrim(joined, F.lit("/"))).otherwise(F.concat(F.rtrim(b, F.lit("/")), F.lit("/"), F.ltrim(p, F.lit("/"))))


def dir_url(url) -> Column:
    """The URL before its last slash; a URL without one, or with one in front only, as it is."""
    u = _c(url)
    head = F.regexp_extract(u, r"^(.+)/[^/]*$", 1)
    return F.when(head == "", u).otherwise(head)


_ATTRIBUTE = r'([A-Za-z0-9-]+)=("[^"]*"|[^",]*)'


def attributes(line) -> Column:
    """Attribute list of a tag line as a map, safe for commas in quotes; the last of equal names wins."""
    text = F.regexp_replace(_c(line), r"^#EXT[A-Z0-9-]*:", "")
    found = F.struct(*(F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(i)).alias(n) for i, n in ((1, "k"), (2, "v"))))

    def last(z: Column) -> Column:
        entries = F.arrays_zip(z["k"].alias("k"), F.transform(z["v"], lambda v: F.btrim(F.trim(v), F.lit('"'))).alias("v"))
        return F.map_from_entries(F.filter(entries, lambda x, i: ~F.array_contains(F.slice(z["k"], i + 2, F.greatest(F.size(z["k"]) - i - 1, F.lit(0))), x["k"])))

    # an array of one, so that the text is searched once and not for each of its attributes
    return F.when(_c(line).isNull(), F.lit(None)).otherwise(F.get(F.transform(F.array(found), last), F.lit(0)))


def byte_range_dash(text) -> Column:
    """a-b as struct(first, last); null unless both are whole numbers."""
    s = _c(text)
    a, b = (F.nullif(F.regexp_extract(s, r"^(\d{1,18})-(\d{1,18})$", i), F.lit("")).try_cast("bigint") for i in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("first"), b.alias("last")))


def byte_range_at(text) -> Column:
    """len or len@offset as struct(length, offset); offset null if absent."""
    s = F.btrim(F.trim(_c(text)), F.lit('"'))
    n, o = (F.nullif(F.regexp_extract(s, r"^(\d{1,18})(?:@(\d{1,18}))?$", i), F.lit("")).try_cast("bigint") for i in (1, 2))
    return F.when(n.isNotNull(), F.struct(n.alias("length"), o.alias("offset")))


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*:)"
_NO_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"


def _without_dots(path: Column) -> Column:
    """A path without its . and .. segments; a .. at its beginning has nothing to take away."""
    inner = F.split(F.regexp_replace(path, "^/", ""), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(inner, none, lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    ended = F.when(path.rlike(r"(^|/)\.\.?$"), F.array(F.lit(""))).otherwise(none)
    clean = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.concat(kept, ended), "/"))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), clean).otherwise(path)


def resolve_uri(base, ref) -> Column:
    """The reference seen from base, by the generic URI syntax (RFC 3986, 5.2), dot segments included. Null for a null
    reference; a null base is empty. Schemes come in small letters; paths that do not begin with / after a scheme stay."""
    b, r = F.coalesce(_c(base), F.lit("")), _c(ref)
    scheme = lambda u: F.lower(F.regexp_extract(u, _SCHEME, 1))
    host = lambda u: F.regexp_extract(u, _NO_SCHEME + "(//[^/?#]*)", 1)
    path = lambda u: F.regexp_extract(u, _NO_SCHEME + "(?://[^/?#]*)?([^?#]*)", 1)
    query = lambda u: F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)
    mark = F.regexp_extract(r, "^[^#]*(#.*)", 1)
    p, site = path(r), F.concat(scheme(b), host(b))
    folder = F.when((host(b) != "") & (path(b) == ""), "/").otherwise(F.regexp_extract(path(b), "^(.*/)", 1))
    return (
        F.when(r.isNull(), F.lit(None).cast("string"))
        .when(r.rlike(_SCHEME), F.concat(scheme(r), host(r), F.when(p.startswith("/"), _without_dots(p)).otherwise(p), query(r), mark))
        .when(r.startswith("//"), F.concat(scheme(b), host(r), _without_dots(p), query(r), mark))
        .when(p == "", F.concat(site, path(b), F.when(query(r) == "", query(b)).otherwise(query(r)), mark))
        .when(p.startswith("/"), F.concat(site, _without_dots(p), query(r), mark))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, p)), query(r), mark))
    )


#: What a content-protection scheme URI holds for each system.
PLAYREADY_MARKS, WIDEVINE_MARK, COMMON_MARK = ["9a04f079-9840-4286-ab92-e65be0885f95", "microsoft:playready"], "edef8ba9-79d6-4ace-a3c8-27dcd51d21ed", "mp4protection"


def drm_system(scheme_uri) -> Column:
    s = F.lower(F.coalesce(_c(scheme_uri), F.lit("")))
    return F.when(s.contains(PLAYREADY_MARKS[0]) | s.contains(PLAYREADY_MARKS[1]), "playready").when(s.contains(WIDEVINE_MARK), "widevine").when(s.contains(COMMON_MARK), "cenc").otherwise("unknown")


def rewrite_license_url(encoded, url) -> Column:
    """A base64 UTF-16LE header with the body of its first LA_URL element replaced; null stays null."""
    text = F.decode(F.unbase64(_c(encoded)), "UTF-16LE")
    open_at = F.instr(text, F.lit("<LA_URL>"))
    close_at = F.instr(text, F.lit("</LA_URL>"))
    changed = F.concat(F.substring(text, F.lit(1), open_at + 7), _c(url), F.substring(text, close_at, F.length(text)))
    return F.base64(F.encode(F.when((open_at > 0) & (close_at > open_at), changed).otherwise(text), "UTF-16LE"))


_PLAIN_ID, _RAW_REP = r"^(?!\.{1,2}$)[A-Za-z0-9._-]+$", r"^(?!\.{1,2}$)(?!~)[^/\\?#%]+$"


def _encoded(s: Column) -> Column:
    return F.concat(F.lit("~"), F.rtrim(F.translate(F.regexp_replace(F.base64(s.cast("binary")), "[\r\n]", ""), "+/", "-_"), F.lit("=")))


def encode_id(ident) -> Column:
    """Ids of letters, digits, dot, underscore and hyphen as they are, others as ~ and base64url without padding."""
    s = _c(ident)
    return F.when(s.rlike(_PLAIN_ID), s).otherwise(_encoded(s))


def encode_rep_id(ident) -> Column:
    """The looser rule for representation ids in URLs: what routes back to itself stays as it is."""
    s = _c(ident)
    return F.when(s.rlike(_RAW_REP), s).otherwise(_encoded(s))


def _decoded(segment, plain: str) -> Column:
    s = _c(segment)
    body = F.translate(F.substring(s, F.lit(2), F.length(s)), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    ident = F.when(body.rlike(r"^[A-Za-z0-9+/]*$") & (F.length(body) % 4 != 1), F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.when(s.startswith("~"), F.when(~ident.rlike(plain), ident)).when(s.rlike(plain), s)


def decode_id(segment) -> Column:
    """What encode_id was given; null for a segment that it never returns."""
    return _decoded(segment, _PLAIN_ID)


def decode_rep_id(segment) -> Column:
    return _decoded(segment, _RAW_REP)


def _root(base) -> Column:
    return F.concat(F.rtrim(_c(base), F.lit("/")), F.lit("/v1/channels/"))


def segment_url(base, channel, period, rep, number, ext) -> Column:
    """One stored segment; ext starts with its dot."""
    return F.concat(_root(base), _c(channel), F.lit("/segments/"), encode_id(period), F.lit("/"), encode_rep_id(rep), F.lit("/"), _c(number).cast("string"), _c(ext))


def init_url(base, channel, period, rep) -> Column:
    return F.concat(_root(base), _c(channel), F.lit("/init/"), encode_id(period), F.lit("/"), encode_rep_id(rep), F.lit(".mp4"))


def playlist_url(base, channel, rep) -> Column:
    return F.concat(_root(base), _c(channel), F.lit("/media/"), encode_rep_id(rep), F.lit(".m3u8"))


def key_url(base, channel, uri) -> Column:
    return F.concat(_root(base), _c(channel), F.lit("/key/"), key_id(uri))


def segment_template(channel, period, rep) -> Column:
    """The media attribute of a manifest's template."""
    return F.concat(F.lit("v1/channels/"), _c(channel), F.lit("/segments/"), encode_id(period), F.lit("/"), encode_rep_id(rep), F.lit("/$Number%09d$.m4s"))


def init_template(channel, period, rep) -> Column:
    return F.concat(F.lit("v1/channels/"), _c(channel), F.lit("/init/"), encode_id(period), F.lit("/"), encode_rep_id(rep), F.lit(".mp4"))


def versioned(url, version) -> Column:
    """url?c=version, or the URL itself for version 0 or none."""
    v = F.coalesce(_c(version).cast("bigint"), F.lit(0))
    return F.when(v == 0, _c(url)).otherwise(F.concat(_c(url), F.lit("?c="), v.cast("string")))


def key_id(uri) -> Column:
    return F.sha2(_c(uri), 256)


#: Prefixes of video codecs, and the audio codec taken where none is named.
VIDEO_CODECS, DEFAULT_AUDIO = ["avc1", "avc3", "hev1", "hvc1", "vp08", "vp09", "av01", "dvh1", "dvhe"], "mp4a.40.2"


def split_codecs(codecs, want_video: bool) -> Column:
    """The video, or the other, codecs of a comma-separated list; no audio named: the default one."""
    parts = F.filter(F.transform(F.split(F.coalesce(_c(codecs), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    video = "^(" + "|".join(VIDEO_CODECS) + ")"
    own = F.array_join(F.filter(parts, lambda x: x.rlike(video) if want_video else ~x.rlike(video)), ",")
    return own if want_video else F.when(own == "", DEFAULT_AUDIO).otherwise(own)


def clean_message(message) -> Column:
    """White space collapsed; at most 200 characters, then an ellipsis."""
    s = F.trim(F.regexp_replace(_c(message), r"\s+", " "))
    return F.when(F.length(s) > 200, F.concat(F.substring(s, 1, 200), F.lit("…"))).otherwise(s)


def classify_outcome(status, stage) -> Column:
    """struct(outcome, delay_s, rotates) of a failed attempt; null outcome where nothing failed.

    Fetch: 410 is dropped, 425 retried after 0.5 s on the same URL, others after 2 s on the next one.
    Write: retried after 1 s. Validate and decrypt: dropped.
    """
    s, at = _c(status), _c(stage)
    make = lambda o, d, r: F.struct(F.lit(o).alias("outcome"), F.lit(d).cast("double").alias("delay_s"), F.lit(r).alias("rotates"))
    return (
        F.when((at == "fetch") & (s == 410), make("drop", None, False)).when((at == "fetch") & (s == 425), make("retry", 0.5, False)).when(at == "fetch", make("retry", 2.0, True))
        .when(at == "write", make("retry", 1.0, False)).when(at.isin("validate", "decrypt"), make("drop", None, False)).otherwise(make(None, None, False))
    )


def valid_ts(content) -> Column:
    """Whole 188-byte packets, the first three of which start with the sync byte."""
    b = _c(content)
    sync = F.lit(bytearray([0x47]))
    ok = (F.octet_length(b) > 0) & (F.octet_length(b) % 188 == 0)
    for i in range(3):
        ok = ok & ((F.octet_length(b) <= 188 * i) | (F.substring(b, 188 * i + 1, 1) == sync))
    return F.coalesce(ok, F.lit(False))


def valid_encrypted(content) -> Column:
    n = F.octet_length(_c(content))
    return F.coalesce((n > 0) & (n % 16 == 0), F.lit(False))


def valid_vtt(content) -> Column:
    b = _c(content)
    mark = lambda x: F.lit(bytearray(x))
    return F.coalesce((F.substring(b, 1, 6) == mark(b"WEBVTT")) | ((F.substring(b, 1, 3) == mark(b"\xef\xbb\xbf")) & (F.substring(b, 4, 6) == mark(b"WEBVTT"))), F.lit(False))


def decrypt_segment(content, key, iv) -> Column:
    """struct(plain, reason) of AES-128-CBC with padding; bad input gives no bytes and a reason."""
    b, k, v = _c(content), _c(key), _c(iv)
    plain = F.try_aes_decrypt(F.concat(v, b), k, F.lit("CBC"), F.lit("DEFAULT"))
    reason = F.when(F.octet_length(k) != 16, "key is not 16 bytes").when(F.octet_length(v) != 16, "iv is not 16 bytes").when(~valid_encrypted(b), "not whole blocks").when(plain.isNull(), "bad padding")
    return F.struct(F.when(reason.isNull(), plain).alias("plain"), reason.alias("reason"))


def config_errors(source_type="source_type", key_mode="key_mode", url="url", content_keys="content_keys") -> Column:
    """Sorted reasons why a channel's configuration is wrong; key digits never show in them."""
    kind, mode, u, keys = F.coalesce(F.nullif(F.lower(_c(source_type)), F.lit("")), F.lit("dash")), F.coalesce(F.nullif(F.lower(_c(key_mode)), F.lit("")), F.lit("passthrough")), _c(url), F.coalesce(_c(content_keys), F.array().cast("array<string>"))
    key_form = r"^[0-9a-fA-F]{32}:[0-9a-fA-F]{32}$"
    kids = F.transform(keys, lambda x: F.lower(F.substring_index(x, ":", 1)))
    return F.array_sort(F.array_compact(F.array(
        F.when(~kind.isin("dash", "hls"), F.lit("unknown source type")),
        F.when(~mode.isin("passthrough", "decrypt"), F.lit("unknown key mode")),
        F.when(~F.coalesce(u.rlike(r"^(?i)https?://"), F.lit(False)), F.lit("source URL is not http or https")),
        F.when(F.coalesce(u.rlike(r"^(?i)https?://(/|$|\?)"), F.lit(False)), F.lit("source URL has no host")),
        F.when(F.exists(keys, lambda x: ~x.rlike(key_form)), F.lit("content key is not 32 hex digits : 32 hex digits")),
        F.when(F.size(F.array_distinct(kids)) < F.size(kids), F.lit("key id is given twice")),
        F.when((F.size(keys) > 0) & ~((kind == "dash") & (mode == "decrypt")), F.lit("content keys need dash in decrypt mode")),
        F.when((F.size(keys) == 0) & (kind == "dash") & (mode == "decrypt"), F.lit("decrypt mode needs a content key")),
    )))


def relative_path(path, directory) -> Column:
    """path relative to directory; null if it is not inside."""
    p, d = _c(path), F.concat(F.regexp_replace(_c(directory), "/+$", ""), F.lit("/"))
    return F.when(p.startswith(d) & ~p.rlike(r"(^|/)\.\.(/|$)"), F.substring(p, F.length(d) + 1, F.length(p)))

"""Explicit schemas of the documents the library reads. Numbers that may be
malformed are read as text and cast with ``try_cast``."""

# Parsed by ``from_json``/``from_xml``; x of a curve stays raw JSON text because it
# is either an array or a {min, max, count} range.
CATALOGUE = """array<struct<title:string, year:string, audioTypes:array<string>, content_type:string, author:string,
 catalogue_url:string, beqcUrl:string, filters:array<struct<type:string, freq:double, gain:double, q:double>>,
 images:array<string>, warning:array<string>, season:string, episode:string, avs:string, sortTitle:string, edition:string,
 note:string, language:string, source:string, overview:string, theMovieDB:string, rating:string, genres:array<string>,
 altTitle:string, created_at:bigint, updated_at:bigint, digest:string, runtime:string, mv:string,
 collection:struct<id:string, name:string>>>"""

FILTER_FIELDS = """_type:string, fs:int, fc:double, q:double, gain:double, count:int, order:int, filter_type:string,
 f0:double, q0:double, fp:double, qp:double, description:string"""
FILTER = f"struct<{FILTER_FIELDS}, filters:array<struct<{FILTER_FIELDS}>>>"

CURVE = "struct<_type:string, name:string, description:string, x:string, y:array<double>>"
SIGNAL_FIELDS = f"""_type:string, name:string, fs:int, data:struct<avg:{CURVE}, peak:{CURVE}, median:{CURVE}>,
 filter:{FILTER}, master_name:string, slave_names:array<string>, duration_seconds:string, start_seconds:string,
 duration_hhmmss:string, start_hhmmss:string, offset:string,
 metadata:struct<src:string, channel:int, start:bigint, `end`:bigint>"""
SIGNAL = f"struct<{SIGNAL_FIELDS}>"
PROJECT = f"""array<struct<{SIGNAL_FIELDS}, channels:array<{SIGNAL}>,
 bm:struct<lpf_fs:double, lpf_position:string, headroom_type:string>, clip:struct<before:boolean, after:boolean>>>"""

OPTIMISER = """struct<mso_filters:array<struct<_type:string, chans:array<string>, delay_val:double, gain_val:double,
 gain:double, fc:double, q:double, filter_type:string, order:int, f0:double, q0:double, fp:double, qp:double>>>"""

PROBE = """struct<format:struct<duration:string>, streams:array<struct<index:int, codec_type:string, codec_name:string,
 codec_long_name:string, profile:string, sample_rate:string, channels:int, channel_layout:string, duration:string,
 width:int, height:int, tags:struct<language:string, DURATION:string>>>>"""

DEVICE_XML = """struct<filter:array<struct<_name:string, freq:string, q:string, boost:string, type:string, bypass:string>>>"""

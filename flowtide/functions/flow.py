"""Scalar expressions over flow fields. All are JVM-side ``Column`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Port and protocol categories.
HTTP_PORTS = [80, 8080]
HTTPS_PORTS = [443]
SSH_PORTS = [22]
DNS_PORTS = [53]
SMTP_PORTS = [25, 465, 587]
FTP_PORTS = [21]
DB_PORTS = [3306, 5432]
WELL_KNOWN_RANGE = (0, 1023)
EPHEMERAL_RANGE = (49152, 65535)
PROTOCOL_NAMES = {6: "TCP", 17: "UDP", 0: "HOPOPT"}
DEFAULT_IP = "0.0.0.0"
ICMP_NUMBER = 1


def port_category(port: Column) -> Column:
    """Service category of a port; the first matching rule wins."""
    p = port.cast("int")
    named = {
        "HTTP": HTTP_PORTS,
        "HTTPS": HTTPS_PORTS,
        "SSH": SSH_PORTS,
        "DNS": DNS_PORTS,
        "SMTP": SMTP_PORTS,
        "FTP": FTP_PORTS,
        "DB": DB_PORTS,
    }
    chain = F.when(p.isNull(), F.lit(None).cast("string"))
    for name, ports in named.items():
        chain = chain.when(p.isin(ports), F.lit(name))
    return (
        chain.when(p.between(*WELL_KNOWN_RANGE), F.lit("Well-Known"))
        .when(p.between(*EPHEMERAL_RANGE), F.lit("Ephemeral"))
        .otherwise(F.lit("Other"))
    )


def protocol_category(protocol: Column, on_unknown: str = "error") -> Column:
    """Protocol name; an unsupported number fails the job, or is ``Other`` on request."""
    if on_unknown not in ("error", "other"):
        raise ValueError("on_unknown is 'error' or 'other'")
    p = protocol.cast("int")
    chain = F.when(p.isNull(), F.lit(None).cast("string"))
    for number, name in PROTOCOL_NAMES.items():
        chain = chain.when(p == number, F.lit(name))
    if on_unknown == "other":
        return chain.otherwise(F.lit("Other"))
    message = F.concat(p.cast("string"), F.lit(" is not a supported protocol number"))
    return chain.otherwise(F.raise_error(message).cast("string"))


def ipv4_or_default(ip: Column, default: str = DEFAULT_IP) -> Column:
    """``ip`` if it is a dotted quad with octets up to 255 and no leading zeros, else the default."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.when(F.coalesce(ip, F.lit("")).rlike(rf"\A{octet}(\.{octet}){{3}}\z"), ip).otherwise(F.lit(default))


def _first_text(match: Column, *names: str) -> Column:
    """First of the match fields that is not empty text."""
    return F.coalesce(*[F.nullif(match[name], F.lit("")) for name in names])


def _first_number(match: Column, *names: str) -> Column:
    """First of the match fields that reads as a number other than zero."""
    return F.coalesce(*[F.nullif(match[name].try_cast("double"), F.lit(0.0)) for name in names])


def match_fields(match: Column) -> dict[str, Column]:
    """Addresses, ports and protocol number as an OpenFlow 1.0 or 1.3 match document has them."""
    return {
        "src_ip": _first_text(match, "ipv4_src", "nw_src"),
        "src_port": _first_number(match, "tcp_src", "tp_src", "udp_src"),
        "dst_ip": _first_text(match, "ipv4_dst", "nw_dst"),
        "dst_port": _first_number(match, "tcp_dst", "tp_dst", "udp_dst"),
        "protocol": _first_number(match, "ip_proto", "nw_proto").cast("int"),
    }


def flow_endpoints(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column) -> dict[str, Column]:
    """Match fields with their defaults; ICMP has no ports and is recorded as protocol 0."""
    icmp = F.coalesce(protocol == ICMP_NUMBER, F.lit(False))

    def port(number: Column) -> Column:
        return F.when(icmp, F.lit(0.0)).otherwise(F.coalesce(number, F.lit(0.0)))

    return {
        "src_ip": ipv4_or_default(src_ip),
        "src_port": port(src_port),
        "dst_ip": ipv4_or_default(dst_ip),
        "dst_port": port(dst_port),
        "protocol": F.when(icmp, F.lit(0)).otherwise(protocol),
    }


def flow_rates(
    duration_sec: Column, duration_nsec: Column, byte_count: Column, packet_count: Column
) -> dict[str, Column]:
    """Duration in microseconds and per-second rates, zero for flows without duration."""

    def number(column: Column) -> Column:
        return F.coalesce(column.cast("double"), F.lit(0.0))

    seconds = number(duration_sec) + number(duration_nsec) / 1_000_000_000
    return {
        "flow_duration": seconds * 1_000_000,
        "flow_bytes_s": F.when(seconds > 0, number(byte_count) / seconds).otherwise(F.lit(0.0)),
        "flow_packets_s": F.when(seconds > 0, number(packet_count) / seconds).otherwise(F.lit(0.0)),
    }


def time_text(moment: Column, utc_suffix: bool = False) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text, optionally with the report's `` UTC`` suffix."""
    text = F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
    return F.concat(text, F.lit(" UTC")) if utc_suffix else text


def two_decimals(number: Column) -> Column:
    return F.format_string("%.2f", number.cast("double"))

"""Executables, link files and images: headers by struct."""

from __future__ import annotations

import struct

from nestlake.processors.base import Collector, Job, Malformed, Reader, Result, filetime, guid, processor


@processor("PE")
def pe(job: Job) -> Result:
    c = job.content
    r = Reader(c)
    if c[:2] != b"MZ":
        raise Malformed("no MZ header")
    at = r.one("I", 0x3C)
    if c[at:at + 4] != b"PE\0\0":
        raise Malformed("no PE header")
    r.at, issues = at + 4, []
    head = r.fields(("machine", "H"), ("number_of_sections", "H"), ("time_date_stamp", "I"), ("pointer_to_symbol_table", "I"), ("number_of_symbols", "I"), ("size_of_optional_header", "H"), ("characteristics", "H"))
    optional, start = {}, r.at
    if head["size_of_optional_header"]:
        magic = r.one("H", start)
        wide = magic == 0x20B
        optional = r.fields(("magic", "H"), ("major_linker_version", "B"), ("minor_linker_version", "B"), ("size_of_code", "I"), ("size_of_initialized_data", "I"), ("size_of_uninitialized_data", "I"), ("address_of_entry_point", "I"), ("base_of_code", "I"))
        if not wide:
            optional["base_of_data"] = r.one("I")
        optional["image_base"] = r.one("Q" if wide else "I")
        optional |= r.fields(("section_alignment", "I"), ("file_alignment", "I"), ("major_os_version", "H"), ("minor_os_version", "H"), ("major_image_version", "H"), ("minor_image_version", "H"),
                             ("major_subsystem_version", "H"), ("minor_subsystem_version", "H"), ("win32_version", "I"), ("size_of_image", "I"), ("size_of_headers", "I"), ("checksum", "I"), ("subsystem", "H"), ("dll_characteristics", "H"))
        if magic not in (0x10B, 0x20B):
            issues.append("OH_BAD_MAGIC")
        if optional["file_alignment"] == 0 or optional["file_alignment"] & (optional["file_alignment"] - 1):
            issues.append("OH_BAD_FILE_ALIGNMENT")
        if optional["section_alignment"] < optional["file_alignment"]:
            issues.append("OH_BAD_SECTION_ALIGNMENT")
    else:
        issues.append("PH_NO_OPTIONAL_HEADER")
    r.at, sections, end = start + head["size_of_optional_header"], [], 0
    for _ in range(head["number_of_sections"]):
        name = r.bytes(8).rstrip(b"\0").decode("latin-1")
        s = {"name": name} | r.fields(("virtual_size", "I"), ("virtual_address", "I"), ("size_of_raw_data", "I"), ("pointer_to_raw_data", "I"), ("pointer_to_relocations", "I"), ("pointer_to_line_numbers", "I"), ("number_of_relocations", "H"), ("number_of_line_numbers", "H"), ("characteristics", "I"))
        sections.append(s)
        end = max(end, s["pointer_to_raw_data"] + s["size_of_raw_data"])
    if end > len(c):
        issues.append("SH_DATA_BEYOND_END")
    return _with_payload(job, {"pe_header": head, "optional_header": optional, "section_headers": sections, "issues": issues}, end)


def _with_payload(job: Job, meta: dict, end: int) -> Result:
    """What follows the image of an executable may be an archive that unpacks itself."""
    out, tail = Collector(job), job.content[end:] if end else b""
    for magic in (b"PK\x03\x04", b"7z\xbc\xaf\x27\x1c", b"Rar!\x1a\x07", b"MSCF"):
        if (k := tail.find(magic)) >= 0:
            out.add(tail[k:], {"offset": end + k}, symbols=["SFX"])
            break
    return Result(meta, out.symbols, out.children)


@processor("ELF")
def elf(job: Job) -> Result:
    c = job.content
    if c[:4] != b"\x7fELF" or len(c) < 20:
        raise Malformed("no ELF header")
    wide, order = c[4] == 2, "<" if c[5] == 1 else ">"
    r, w, issues = Reader(c, order, 16), "Q" if c[4] == 2 else "I", []
    head = {"class": c[4], "data": c[5], "version": c[6], "osabi": c[7], "abiversion": c[8]}
    head |= r.fields(("type", "H"), ("machine", "H"), ("file_version", "I"), ("entry", w), ("phoff", w), ("shoff", w), ("flags", "I"), ("ehsize", "H"), ("phentsize", "H"), ("phnum", "H"), ("shentsize", "H"), ("shnum", "H"), ("shstrndx", "H"))
    if c[4] not in (1, 2):
        issues.append("EH_BAD_CLASS")
    if head["file_version"] != 1:
        issues.append("EH_BAD_VERSION")
    programs, sections, end = [], [], 0
    for k in range(head["phnum"]):
        r.at = head["phoff"] + k * head["phentsize"]
        if r.at + head["phentsize"] > len(c):
            issues.append("PH_BEYOND_END")
            break
        p = r.fields(("type", "I"), ("flags", "I"), ("offset", "Q"), ("vaddr", "Q"), ("paddr", "Q"), ("filesz", "Q"), ("memsz", "Q"), ("align", "Q")) if wide else r.fields(
            ("type", "I"), ("offset", "I"), ("vaddr", "I"), ("paddr", "I"), ("filesz", "I"), ("memsz", "I"), ("flags", "I"), ("align", "I"))
        programs.append(p)
        end = max(end, p["offset"] + p["filesz"])
    for k in range(head["shnum"]):
        r.at = head["shoff"] + k * head["shentsize"]
        if r.at + head["shentsize"] > len(c):
            issues.append("SH_BEYOND_END")
            break
        s = r.fields(("name", "I"), ("type", "I"), ("flags", w), ("addr", w), ("offset", w), ("size", w), ("link", "I"), ("info", "I"), ("addralign", w), ("entsize", w))
        sections.append(s)
        if s["type"] != 8:
            end = max(end, s["offset"] + s["size"])
    if sections and head["shstrndx"] < len(sections):
        base = sections[head["shstrndx"]]["offset"]
        for s in sections:
            s["name"] = c[base + s["name"]:].partition(b"\0")[0][:256].decode("latin-1")
    end = max(end, head["shoff"] + head["shnum"] * head["shentsize"])
    return _with_payload(job, {"header": head, "program_headers": programs, "section_headers": sections, "issues": sorted(set(issues))}, end)


@processor("MACHO", "MachO")
def macho(job: Job) -> Result:
    c = job.content
    kinds = {b"\xfe\xed\xfa\xce": (">", False), b"\xce\xfa\xed\xfe": ("<", False), b"\xfe\xed\xfa\xcf": (">", True), b"\xcf\xfa\xed\xfe": ("<", True)}
    if c[:4] not in kinds:
        raise Malformed("no Mach-O header")
    order, wide = kinds[c[:4]]
    r = Reader(c, order)
    head = r.fields(("magic", "I"), ("cputype", "I"), ("cpusubtype", "I"), ("filetype", "I"), ("ncmds", "I"), ("sizeofcmds", "I"), ("flags", "I"))
    if wide:
        r.bytes(4)
    commands, w = [], "Q" if wide else "I"
    for _ in range(min(head["ncmds"], 4096)):
        start = r.at
        cmd, size = r.get("II")
        item = {"cmd": cmd, "size": size}
        if cmd in (1, 0x19):
            item["segname"] = r.bytes(16).rstrip(b"\0").decode("latin-1")
            item |= r.fields(("vmaddr", w), ("vmsize", w), ("fileoff", w), ("filesize", w), ("maxprot", "I"), ("initprot", "I"), ("nsects", "I"), ("flags", "I"))
            item["sections"] = []
            for _ in range(min(item["nsects"], 255)):
                sect, seg = (r.bytes(16).rstrip(b"\0").decode("latin-1") for _ in range(2))
                item["sections"].append({"sectname": sect, "segname": seg} | r.fields(("addr", w), ("size", w), ("offset", "I"), ("align", "I"), ("reloff", "I"), ("nreloc", "I"), ("flags", "I")))
                r.bytes(12 if wide else 8)
        if size < 8:
            raise Malformed("bad load command")
        commands.append(item)
        r.at = start + size
    return Result({"header": head, "load_commands": commands})


@processor("UNIBIN", "UniversalBinary")
def universal(job: Job) -> Result:
    r = Reader(job.content, ">")
    magic, n = r.get("II")
    if magic not in (0xCAFEBABE, 0xCAFEBABF) or n > 64:
        raise Malformed("no universal binary")
    out = Collector(job)
    for _ in range(n):
        a = r.fields(("cputype", "I"), ("cpusubtype", "I"), ("offset", "I"), ("size", "I"), ("align", "I")) if magic == 0xCAFEBABE else r.fields(("cputype", "I"), ("cpusubtype", "I"), ("offset", "Q"), ("size", "Q"), ("align", "I"), ("reserved", "I"))
        body = job.content[a["offset"]:a["offset"] + a["size"]]
        out.add(body if len(body) == a["size"] else None, a, "MachO", [] if len(body) == a["size"] else ["CORRUPTED"])
    return Result({"magic": magic, "nfat_arch": n}, out.symbols, out.children)


# Names of link flags from bit 0, and drive types from 0.
LINK_FLAGS = ("HasLinkTargetIDList", "HasLinkInfo", "HasName", "HasRelativePath", "HasWorkingDir", "HasArguments", "HasIconLocation", "IsUnicode", "ForceNoLinkInfo", "HasExpString", "RunInSeparateProcess")
DRIVES = ("DRIVE_UNKNOWN", "DRIVE_NO_ROOT_DIR", "DRIVE_REMOVABLE", "DRIVE_FIXED", "DRIVE_REMOTE", "DRIVE_CDROM", "DRIVE_RAMDISK")


@processor("LNK", "Lnk")
def lnk(job: Job) -> Result:
    c = job.content
    r = Reader(c)
    size = r.one("I")
    if size != 0x4C:
        raise Malformed("no link header")
    clsid, flags, attributes = guid(r.bytes(16)), *r.get("II")
    created, accessed, written, length, icon, show, hotkey = r.get("QQQIiIH")
    header = {"header_size": size, "link_clsid": clsid, "link_flags": [n for k, n in enumerate(LINK_FLAGS) if flags >> k & 1], "file_attributes": attributes, "creation_time": filetime(created),
              "access_time": filetime(accessed), "write_time": filetime(written), "file_size": length, "icon_index": icon, "show_command": show, "hot_key": hotkey}
    r.at, meta = 0x4C, {"shell_link_header": header}
    if flags & 1:
        n = r.one("H")
        stop, items = r.at + n, []
        while r.at + 2 <= stop and (k := r.one("H")) >= 2:
            body = r.bytes(k - 2)
            items.append({"item_size": k, "class_type": body[0] if body else None})
        meta["link_target_id_list"] = {"id_list_size": n, "id_list": {"item_id_list": items}}
        r.at = stop
    if flags & 2:
        start = r.at
        total, head, bits, volume, base, network, _ = r.get("IIIIIII")
        text = lambda at: c[at:].partition(b"\0")[0].decode("cp1252", "replace")
        info = {"link_info_size": total, "link_info_header_size": head, "link_info_flags": [n for k, n in enumerate(("VolumeIDAndLocalBasePath", "CommonNetworkRelativeLinkAndPathSuffix")) if bits >> k & 1]}
        if bits & 1:
            v = Reader(c, at=start + volume)
            vsize, drive, serial, label = v.get("IIII")
            info["volume_id"] = {"volume_id_size": vsize, "drive_type": DRIVES[drive] if drive < len(DRIVES) else str(drive), "drive_serial_number": serial, "volume_label_offset": label, "volume_label": text(start + volume + label)}
            info["local_base_path"] = text(start + base)
        if bits & 2:
            v = Reader(c, at=start + network)
            nsize, _, name, device, provider = v.get("IIIII")
            info["common_network_relative_link"] = {"common_network_relative_link_size": nsize, "net_name": text(start + network + name), "device_name": text(start + network + device) if device else None, "network_provider_type": f"0x{provider:08x}"}
        meta["link_info"] = info
        r.at = start + total
    strings, symbols = {}, []
    for bit, name in ((2, "name_string"), (3, "relative_path"), (4, "working_dir"), (5, "command_line_arguments"), (6, "icon_location")):
        if flags >> bit & 1:
            n = r.one("H")
            strings[name] = r.bytes(n * 2).decode("utf-16-le", "replace") if flags & 0x80 else r.bytes(n).decode("cp1252", "replace")
    meta["string_data"], blocks = strings, []
    while r.at + 8 <= len(c) and (n := r.one("I", r.at)) >= 4:
        blocks.append({"block_size": n, "block_signature": r.one("I", r.at + 4)})
        r.at += n
    meta["extra_data"] = blocks
    if strings.get("command_line_arguments"):
        symbols.append("HAS_ARGUMENTS")
    return Result(meta, symbols)


@processor("Image", "IMAGE")
def image(job: Job) -> Result:
    """Format and size from the header; pixels are not decoded in this build."""
    c = job.content
    if c[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, depth, colour = struct.unpack(">IIBB", c[16:26])
        kind = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(colour, "unknown")
        return Result({"format": "PNG", "pixel_format": f"{kind}{depth}", "width": w, "height": h})
    if c[:6] in (b"GIF87a", b"GIF89a"):
        w, h = struct.unpack("<HH", c[6:10])
        return Result({"format": "GIF", "pixel_format": "P8", "width": w, "height": h})
    if c[:2] == b"BM":
        w, h, _, bits = struct.unpack("<iiHH", c[18:30])
        return Result({"format": "BMP", "pixel_format": f"RGB{bits}", "width": w, "height": abs(h)})
    if c[:2] == b"\xff\xd8":
        k = 2
        while k + 9 < len(c) and c[k] == 0xFF:
            m, n = c[k + 1], struct.unpack(">H", c[k + 2:k + 4])[0]
            if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
                depth, h, w, parts = struct.unpack(">BHHB", c[k + 4:k + 10])
                return Result({"format": "JPEG", "pixel_format": f"{ {1: 'L', 3: 'RGB', 4: 'CMYK'}.get(parts, 'unknown') }{depth}", "width": w, "height": h})
            k += 2 + n
        raise Malformed("no frame header")
    head = c[:4096].lstrip().lower()
    if b"<svg" in head:
        text = c.decode("utf-8", "replace").lower()
        return Result({"format": "SVG"}, ["SVG_JS"] if "<script" in text or "javascript:" in text or " onload=" in text else [])
    raise Malformed("unknown image format")

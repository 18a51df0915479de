"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from cairn.llm import decontaminate, huffman, langid, licences, linededup, merkle, neighbours, packing, quality, resample, simhash, urlfilter, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_langid": langid.op2_langid,
        "op3_warc": warc.op3_warc,
        "op4_licences": licences.op4_licences,
        "op5_linededup": linededup.op5_linededup,
        "op6_huffman": huffman.op6_huffman,
        "op7_packing": packing.op7_packing,
        "op8_urlfilter": urlfilter.op8_urlfilter,
        "op9_quality": quality.op9_quality,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_merkle": merkle.op11_merkle,
        "op12_resample": resample.op12_resample,
        "op13_neighbours": neighbours.op13_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": warc.OP3_SQL,
        "op5_linededup": linededup.OP5_SQL,
        "op10_decontaminate": decontaminate.OP10_SQL,
        "op11_merkle": merkle.OP11_SQL,
        "op12_resample": resample.OP12_SQL,
        "op13_neighbours": neighbours.OP13_SQL,
    }

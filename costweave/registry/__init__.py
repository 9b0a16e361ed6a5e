"""Every operator as a named query over the sample tables."""

from costweave.registry.entries import Entries


def all_entries() -> Entries:
    from costweave.registry import analysis, blocks, quality, storage, texts

    entries = Entries()
    for module in (analysis, blocks, quality, storage, texts):
        module.register(entries)
    return entries

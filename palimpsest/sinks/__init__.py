"""Writers: idempotent appends, content-addressed blobs, event payloads, inventories."""

"""Where rows come from: files, archives, packs, stores, logs."""

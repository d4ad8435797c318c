"""Where rows come from: fixture tables, wire frames, logs and documents."""

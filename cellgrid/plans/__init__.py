"""cellgrid.plans"""
